"""The registered queries of the planning and search operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, tokens
from ..operators import balance, components, composite, dominance, normalize, planner, reach, reports, search, tags
from ..sources import derived, sinks, tables
from ..sources.derived import Graph, graph

TARGETS = (1, 2, 3)
WORDS = ("red", "st", "blue", "small", "1", "part", "brand", "x")


def _normal(spark: SparkSession, sf_dir: str, byproducts: bool = False) -> Graph:
    return normalize.normalized(graph(spark, sf_dir, byproducts))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    of = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("amount").alias("total")).withColumn("name", F.lit(name))
    return of(g.outputs, "outputs").unionByName(of(g.inputs, "inputs")).unionByName(of(g.stations.withColumn("amount", F.col("item_id").cast("long")), "stations"))


def net_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.net(graph(spark, sf_dir))


def leaf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.inputs.select("item_id").distinct().join(g.outputs, "item_id", "left_anti")


def useful_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.drop_useless(graph(spark, sf_dir)).recipes


def canonical_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _normal(spark, sf_dir)
    return normalize.packed(g).select("recipe_id", "anchor", "anchor_amt", "cost", F.size("stations").cast("long").alias("n_stations"))


def direct_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.direct_dominance(_normal(spark, sf_dir))


def direct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.direct_pairs(_normal(spark, sf_dir))


def direct_pairs_byproducts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.direct_pairs(_normal(spark, sf_dir, byproducts=True))


def per_unit_pairs_byproducts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.per_unit_pairs(_normal(spark, sf_dir, byproducts=True))


def canonical_byproducts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir, byproducts=True).recipes


def producer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.outputs.groupBy("item_id").agg(F.count("*").alias("producers"), F.min("amount").alias("least"), F.max("amount").alias("most"))


def item_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    out = g.outputs.groupBy("item_id").agg(F.count("*").alias("made_by"))
    into = g.inputs.groupBy("item_id").agg(F.count("*").alias("used_by"))
    return out.join(into, "item_id", "full").select("item_id", F.coalesce("made_by", F.lit(0)).cast("long").alias("made_by"), F.coalesce("used_by", F.lit(0)).cast("long").alias("used_by"))


def _requests(spark: SparkSession, g: Graph) -> tuple[DataFrame, DataFrame]:
    """Three targets; query k may use the stations whose number leaves k when divided by three."""
    targets = spark.createDataFrame([(k, t) for k, t in enumerate(TARGETS)], "query_id int, item_id int")
    stations = g.stations.select("item_id").distinct().select((F.col("item_id") % 3).alias("query_id"), "item_id")
    return targets, stations


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = normalize.stored(graph(spark, sf_dir))
    items, recipes = reach.walk(g, *_requests(spark, g))
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    return count(items, "n_items").join(count(recipes, "n_recipes"), "query_id", "left").na.fill(0)


def reachable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = normalize.stored(graph(spark, sf_dir))
    return reach.walk(g, *_requests(spark, g))[0]


def needed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = normalize.stored(graph(spark, sf_dir))
    return reach.needed_items(g, _requests(spark, g)[0])


def seed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that can be made from nothing but what input-free recipes give, among the recipes walked for each request."""
    g = normalize.stored(graph(spark, sf_dir))
    targets, stations = _requests(spark, g)
    recipes = reach.walk(g, targets, stations)[1]
    return reach.fireable(g, recipes, targets.limit(0))[0]


def plan_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of the plan that runs every recipe once."""
    g = graph(spark, sf_dir)
    runs = g.recipes.select(F.lit(0).alias("query_id"), "recipe_id", F.lit(1).cast("long").alias("cnt"))
    demand = spark.createDataFrame([(0, t, 100) for t in TARGETS], "query_id int, item_id int, amount long")
    return balance.balances(g, runs, demand).select("item_id", F.col("balance").cast("long").alias("balance"), F.col("missing").cast("long").alias("missing"))


def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    runs = g.recipes.select((F.col("anchor") % 5).alias("query_id"), "recipe_id", (F.col("anchor_amt") % 4).alias("cnt"))
    return balance.costs(g, runs)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select((F.col("p_partkey") + 1).alias("handle"), F.concat_ws(":", F.lower("p_brand"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("resource_id"), F.col("p_name").alias("name_en"), F.lit(None).cast("string").alias("name_zh"))


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("handle", F.explode(tokens(F.col("resource_id"))).alias("token")).groupBy("token").agg(F.count("*").alias("uses"), F.countDistinct("handle").alias("entries"))


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(WORDS)), "query_id int, query string")
    return search.search(search.indexed(_names(spark, sf_dir)), queries, 50)


def names_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases (folded English names) with their first handle and the number of entries that share them."""
    return _names(spark, sf_dir).groupBy(folded(F.col("name_en")).alias("alias")).agg(F.min("handle").alias("handle"), F.count("*").alias("entries"))


def per_unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.per_unit_pairs(_normal(spark, sf_dir))


def composite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.composite_pairs(_normal(spark, sf_dir))


def composite_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = composite.composite_marks(_normal(spark, sf_dir))
    return marks.select("recipe_id", "guard", F.size("stations").alias("n_stations"))


def repaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes that are still marked after an item all of whose producers give fewer than thirty units has its first back."""
    g = graph(spark, sf_dir)
    return dominance.repaired(g, g.recipes.where("anchor_amt < 30 AND recipe_id >= 0").select("recipe_id"))


def usable_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request, the directly dominated recipes that its stations let it drop."""
    g = _normal(spark, sf_dir)
    return dominance.usable(dominance.direct_marks(g), _requests(spark, g)[1]).groupBy("query_id").agg(F.count("*").alias("n_recipes"))


def tag_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.within_budget(graph(spark, sf_dir), 1024, 100_000)


def exclusive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.exclusive_items(normalize.stored(graph(spark, sf_dir)))


def tag_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_exclusive(normalize.stored(graph(spark, sf_dir)))


def closed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recipes are left to each request once closed islands are gone."""
    g = normalize.stored(graph(spark, sf_dir))
    return reach.inside_needed(g, _requests(spark, g)[0]).groupBy("query_id").agg(F.count("*").alias("n_recipes"))


def cost_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of making a hundred of each item."""
    g = graph(spark, sf_dir)
    made = g.outputs.select(F.col("item_id").cast("long").alias("query_id"), "item_id").distinct().withColumn("amount", F.lit(100).cast("long"))
    return planner.cost_bounds(g, made)


def component_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the strong component of item 1."""
    comp = components.strong_components(components.item_edges(normalize.stored(graph(spark, sf_dir))))
    return comp.join(comp.where("node = 1").select("component"), "component", "left_semi").select(F.col("node").alias("item_id"))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the recipe graph with the largest item of its strong component."""
    comp = components.strong_components(components.item_edges(normalize.stored(graph(spark, sf_dir))))
    return comp.select(F.col("node").alias("item_id"), "component")


def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.statistics(normalize.stored(graph(spark, sf_dir)))


def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.renumbered(_normal(spark, sf_dir))


def mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _normal(spark, sf_dir, byproducts=True)
    rows = dominance.makers(g)
    return sinks.mark_counts(g, {"directly_dominated": dominance.direct_pairs(g, rows=rows), "dominated_a_unit": dominance.per_unit_pairs(g, rows=rows)})


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary(graph(spark, sf_dir, byproducts=True)).withColumn("inputs_a_recipe", F.round("inputs_a_recipe", 6))


def plan_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for a hundred of each of three targets, with a third of the stations each and no stock."""
    g = normalize.stored(graph(spark, sf_dir))
    targets, stations = _requests(spark, g)
    stock = targets.withColumn("amount", F.lit(1).cast("long")).limit(0)
    status, runs = planner.plan(g, targets.withColumn("amount", F.lit(100).cast("long")), stations, stock)
    uses = runs.groupBy("query_id").agg(F.count("*").alias("n_recipes"))
    return status.join(uses, "query_id", "left").select("query_id", "status", "proven_optimal", "objective", "best_bound", F.coalesce("n_recipes", F.lit(0)).alias("n_recipes"))


def plan_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest shortfalls of the plan of `plan_balance`."""
    short = reports.missing_lists(plan_balance(spark, sf_dir).withColumn("query_id", F.lit(0)))
    return short.select("n_missing", F.posexplode("shortfalls").alias("rank", "x")).select("n_missing", "rank", "x.item_id", "x.missing")


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inventory a brand, written as text and read back; item 7 is beyond the range of the first six."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("text", F.concat(F.col("p_partkey") % 8, F.lit("="), F.col("p_size")))
    read = tables.inventory(part, "text", 6)
    return read.groupBy("p_brand").agg(F.count("error").alias("bad"), F.sum(F.get("stock", F.lit(0))["amount"]).alias("amount"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as measured plans: priorities are configurations, customers' points of the truth."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderpriority").alias("config"), "o_custkey", F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "infeasible").otherwise("timeout").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("proven_optimal"), F.col("o_totalprice").alias("cost"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 101).cast("double")).alias("plan_ms"), F.when(F.col("o_orderkey") % 3 == 1, (F.col("o_orderkey") % 103).cast("double")).alias("query_ms"), F.lit(1.0).alias("reach_ms"), F.lit(None).cast("double").alias("solve_ms"))
    truth = orders.where("o_custkey % 4 <> 0").groupBy("o_custkey").agg((F.min("o_orderkey") % 2 == 0).alias("true_feasible"), F.min("o_totalprice").alias("best_cost"))
    return reports.summary(reports.with_truth(reports.derived(rows), truth, ["o_custkey"]), ["config"]).withColumn("cost_ratio", F.round("cost_ratio", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (graph_counts, net_columns, leaf_items, useful_recipes, canonical_recipes, direct_pairs, direct_pairs_byproducts, per_unit_pairs_byproducts, canonical_byproducts, direct_dominance, producer_stats, item_degrees, reachable, reachable_items, needed_items, seed_closure, plan_balance, plan_costs, name_tokens, name_search, names_ambiguous, per_unit_pairs, composite_pairs, composite_marks, repaired_marks, usable_marks, tag_budget, exclusive_items, tag_exclusive, closed_islands, cost_bounds, component_of_first, strong_components, component_statistics, recipe_rows, mark_counts, graph_summary, plan_statuses, plan_shortfalls, inventories, report_summary)}

_NORMAL = """
eaten AS (SELECT o.recipe_id, bool_or(o.amount > coalesce(i.amount, 0)) AS gains FROM outputs o LEFT JOIN inputs i USING (recipe_id, item_id) GROUP BY 1),
useful AS (SELECT * FROM recipes WHERE recipe_id < 0 OR (recipe_id IN (SELECT recipe_id FROM eaten WHERE gains) AND recipe_id IN (SELECT recipe_id FROM stations))),
sig AS (SELECT u.recipe_id, anchor, anchor_amt, cost, coalesce((SELECT string_agg(item_id || 'x' || amount, ',' ORDER BY item_id) FROM inputs i WHERE i.recipe_id = u.recipe_id AND amount > 0), '') || '>' || (SELECT string_agg(item_id || 'x' || amount, ',' ORDER BY item_id) FROM outputs o WHERE o.recipe_id = u.recipe_id) AS ins FROM useful u),
merged AS (SELECT recipe_id, min(recipe_id) OVER (PARTITION BY anchor, anchor_amt, cost, ins) AS survivor FROM sig),
canon AS (SELECT * FROM recipes WHERE recipe_id IN (SELECT survivor FROM merged)),
cstations AS (SELECT DISTINCT survivor AS recipe_id, item_id FROM merged JOIN stations USING (recipe_id)),
cin AS (SELECT i.*, c.anchor FROM inputs i JOIN canon c USING (recipe_id) WHERE recipe_id >= 0),
sized AS (SELECT c.*, (SELECT count(*) FROM cin i WHERE i.recipe_id = c.recipe_id) AS n, c.recipe_id IN (SELECT recipe_id FROM cin WHERE item_id = anchor) AS selfish FROM canon c WHERE recipe_id >= 0),
col AS (SELECT recipe_id, item_id, sum(x)::BIGINT AS coef FROM (SELECT recipe_id, item_id, amount AS x FROM outputs UNION ALL SELECT recipe_id, item_id, -amount FROM inputs WHERE amount > 0) WHERE recipe_id IN (SELECT recipe_id FROM canon) GROUP BY 1, 2 HAVING sum(x) <> 0),
mk AS (SELECT o.item_id, o.recipe_id, o.amount AS out, c.cost, EXISTS (SELECT 1 FROM inputs i WHERE i.recipe_id = o.recipe_id AND i.item_id = o.item_id AND i.amount > 0) AS eats FROM outputs o JOIN canon c USING (recipe_id), n WHERE o.item_id <= n_parts + n_supp),
sib AS (SELECT r.item_id, r.recipe_id, s.recipe_id AS dominator, r.out AS r_out, s.out AS s_out FROM mk r JOIN mk s USING (item_id) WHERE r.recipe_id <> s.recipe_id AND s.cost <= r.cost AND NOT s.eats),
both_ AS (SELECT b.*, c.item_id AS part, c.coef AS r_coef, 0 AS s_coef FROM sib b JOIN col c ON c.recipe_id = b.recipe_id UNION ALL SELECT b.*, c.item_id, 0, c.coef FROM sib b JOIN col c ON c.recipe_id = b.dominator),
cell AS (SELECT item_id, recipe_id, dominator, r_out, s_out, part, sum(r_coef)::HUGEINT AS r, sum(s_coef)::HUGEINT AS s FROM both_ GROUP BY ALL),
pairs AS (SELECT item_id, recipe_id, dominator FROM cell WHERE r_out <= s_out GROUP BY 1, 2, 3 HAVING bool_and(r <= s)),
unit AS (SELECT item_id, recipe_id, dominator FROM cell GROUP BY 1, 2, 3 HAVING bool_and(r * s_out <= s * r_out) AND bool_or(r * s_out < s * r_out)),
top AS (SELECT p.* FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.item_id = p.item_id AND q.recipe_id = p.dominator)),
marked AS (SELECT * FROM top t WHERE item_id = (SELECT max(item_id) FROM top u WHERE u.recipe_id = t.recipe_id))
"""
_REQ = """
targets AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) t(query_id, item_id)),
allowed AS (SELECT DISTINCT item_id % 3 AS query_id, recipe_id FROM stations UNION SELECT query_id, recipe_id FROM (VALUES (0), (1), (2)) q(query_id), recipes WHERE recipe_id < 0),
edges AS (SELECT DISTINCT query_id, o.item_id, i.item_id AS other FROM allowed JOIN outputs o USING (recipe_id) JOIN inputs i USING (recipe_id)),
walked AS (SELECT query_id, item_id FROM targets UNION SELECT e.query_id, e.other FROM walked w JOIN edges e ON e.query_id = w.query_id AND e.item_id = w.item_id),
used AS (SELECT DISTINCT w.query_id, recipe_id FROM walked w JOIN outputs o USING (item_id) JOIN allowed a USING (query_id, recipe_id))
"""
_NAMES = """
names AS (SELECT p_partkey + 1 AS handle, lower(p_brand) || ':' || replace(p_name, ' ', '_') AS resource_id, p_name AS name_en FROM part)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip() for p in (derived.SQL, *parts)) + "\n"


def _kept(sql: str) -> str:
    """`sql` with every common table computed once."""
    return re.sub(r"\b([a-z_]+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", sql)


_BALANCE = _with() + "SELECT item_id::INT AS item_id, sum(x)::BIGINT AS balance, greatest(-sum(x), 0)::BIGINT AS missing FROM (SELECT item_id, sum(x) AS x FROM (SELECT recipe_id, item_id, sum(x) AS x FROM (SELECT recipe_id, item_id, amount AS x FROM outputs UNION ALL SELECT recipe_id, item_id, -amount FROM inputs) GROUP BY 1, 2 HAVING sum(x) <> 0) JOIN recipes USING (recipe_id) GROUP BY 1 UNION ALL SELECT * FROM (VALUES (1, -100), (2, -100), (3, -100)) v(a, b)) GROUP BY 1"

_BY = "WITH " + ",".join(p.strip() for p in (derived.BYPRODUCTS, _NORMAL)) + "\n"

SQL: dict[str, str] = {
    "graph_counts": _with() + "SELECT 'outputs' AS name, count(*) AS n, sum(amount)::BIGINT AS total FROM outputs UNION ALL SELECT 'inputs', count(*), sum(amount)::BIGINT FROM inputs UNION ALL SELECT 'stations', count(*), sum(item_id)::BIGINT FROM stations",
    "net_columns": _with() + "SELECT recipe_id, item_id::INT AS item_id, sum(x)::BIGINT AS coef FROM (SELECT recipe_id, item_id, amount AS x FROM outputs UNION ALL SELECT recipe_id, item_id, -amount FROM inputs) GROUP BY 1, 2 HAVING sum(x) <> 0",
    "leaf_items": _with() + "SELECT DISTINCT item_id::INT AS item_id FROM inputs WHERE item_id NOT IN (SELECT item_id FROM outputs)",
    "useful_recipes": _with(_NORMAL) + "SELECT recipe_id, anchor::INT AS anchor, anchor_amt::BIGINT AS anchor_amt, cost::BIGINT AS cost FROM useful",
    "canonical_recipes": _with(_NORMAL) + "SELECT recipe_id, anchor::INT AS anchor, anchor_amt::BIGINT AS anchor_amt, cost::BIGINT AS cost, (SELECT count(*) FROM cstations s WHERE s.recipe_id = c.recipe_id) AS n_stations FROM canon c",
    "direct_pairs": _with(_NORMAL) + "SELECT item_id::INT AS item_id, recipe_id, dominator FROM pairs",
    "direct_pairs_byproducts": _BY + "SELECT item_id::INT AS item_id, recipe_id, dominator FROM pairs",
    "per_unit_pairs_byproducts": _BY + "SELECT item_id::INT AS item_id, recipe_id, dominator FROM unit",
    "canonical_byproducts": _BY + "SELECT recipe_id, anchor::INT AS anchor, anchor_amt::BIGINT AS anchor_amt, cost::BIGINT AS cost FROM canon",
    "direct_dominance": _with(_NORMAL) + "SELECT m.recipe_id, count(DISTINCT dominator) AS n_dominators, count(DISTINCT s.item_id) AS n_stations FROM marked m LEFT JOIN cstations s ON s.recipe_id = dominator GROUP BY 1",
    "producer_stats": _with() + "SELECT item_id::INT AS item_id, count(*) AS producers, min(amount)::BIGINT AS least, max(amount)::BIGINT AS most FROM outputs GROUP BY 1",
    "item_degrees": _with() + "SELECT coalesce(o.item_id, i.item_id)::INT AS item_id, coalesce(made_by, 0) AS made_by, coalesce(used_by, 0) AS used_by FROM (SELECT item_id, count(*) AS made_by FROM outputs GROUP BY 1) o FULL JOIN (SELECT item_id, count(*) AS used_by FROM inputs GROUP BY 1) i ON o.item_id = i.item_id",
    "reachable": _with(_REQ, recursive=True) + "SELECT query_id::INT AS query_id, n_items, coalesce(n_recipes, 0) AS n_recipes FROM (SELECT query_id, count(*) AS n_items FROM walked GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n_recipes FROM used GROUP BY 1) USING (query_id)",
    "reachable_items": _with(_REQ, recursive=True) + "SELECT query_id::INT AS query_id, item_id::INT AS item_id FROM walked",
    "needed_items": _with("""
targets AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) t(query_id, item_id)),
edges AS (SELECT DISTINCT o.item_id, i.item_id AS other FROM outputs o JOIN inputs i USING (recipe_id)),
needed AS (SELECT query_id, item_id FROM targets UNION SELECT w.query_id, e.other FROM needed w JOIN edges e USING (item_id))""", recursive=True) + "SELECT query_id::INT AS query_id, item_id::INT AS item_id FROM needed",
    "plan_balance": _BALANCE,
    "plan_shortfalls": "SELECT count(*) OVER () AS n_missing, (row_number() OVER (ORDER BY missing DESC, item_id) - 1)::INT AS rank, item_id, missing FROM (" + _BALANCE + ") WHERE missing > 0 QUALIFY rank < 12",
    "plan_costs": _with() + "SELECT (anchor % 5)::INT AS query_id, sum(cost * (anchor_amt % 4))::BIGINT AS objective, sum(CASE WHEN recipe_id >= 0 THEN anchor_amt % 4 ELSE 0 END)::BIGINT AS real_exec, sum(CASE WHEN recipe_id < 0 THEN anchor_amt % 4 ELSE 0 END)::BIGINT AS tag_exec, count(*) AS distinct_recipes FROM recipes WHERE anchor_amt % 4 > 0 GROUP BY 1",
    "name_tokens": "WITH" + _NAMES + "SELECT token, count(*) AS uses, count(DISTINCT handle) AS entries FROM (SELECT handle, unnest(regexp_extract_all(lower(resource_id), '[a-z0-9]+')) AS token FROM names) GROUP BY 1",
    "names_ambiguous": "WITH" + _NAMES + "SELECT lower(name_en) AS alias, min(handle) AS handle, count(*) AS entries FROM names GROUP BY 1",
    "name_search": "WITH" + _NAMES + """,
q AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, '{w}')" for k, w in enumerate(WORDS)) + """) t(query_id, q)),
f AS (SELECT handle, 0 AS field, regexp_extract_all(lower(name_en), '[a-z0-9]+') AS ts FROM names UNION ALL SELECT handle, 2, regexp_extract_all(lower(resource_id), '[a-z0-9]+') FROM names),
m AS (SELECT query_id, handle, field, len(ts) AS n, q, ts, list_position(list_transform(ts, lambda t: starts_with(t, q)), true) AS b, list_position(list_transform(ts, lambda t: contains(t, q)), true) AS i FROM f, q),
s AS (SELECT query_id, handle, CASE WHEN b > 0 THEN CASE WHEN b = 1 AND n = 1 AND ts[1] = q THEN 0 WHEN b = 1 THEN 1 ELSE 2 END ELSE 5 END AS kind, field, coalesce(nullif(b, 0), i) AS pos FROM m WHERE b > 0 OR i > 0),
best AS (SELECT query_id, handle, min((kind, field, pos)) AS k FROM s GROUP BY 1, 2),
r AS (SELECT query_id, handle, k[1] AS kind, row_number() OVER (PARTITION BY query_id ORDER BY k, handle) AS rank FROM best)
SELECT query_id::INT AS query_id, rank::INT AS rank, handle, kind FROM r WHERE rank <= 50""",
    "per_unit_pairs": _with(_NORMAL) + "SELECT item_id::INT AS item_id, recipe_id, dominator FROM unit",
    "composite_pairs": _kept(_with(_NORMAL, """
cnet AS (SELECT recipe_id, item_id, sum(x)::BIGINT AS coef FROM (SELECT recipe_id, anchor AS item_id, anchor_amt AS x FROM canon UNION ALL SELECT recipe_id, item_id, -amount FROM inputs WHERE recipe_id IN (SELECT recipe_id FROM canon) AND amount > 0) GROUP BY 1, 2 HAVING sum(x) <> 0),
csib AS (SELECT r.anchor AS x, r.recipe_id AS r, s.recipe_id AS s, r.cost AS r_cost, s.cost AS s_cost FROM sized r JOIN sized s ON r.anchor = s.anchor AND r.recipe_id <> s.recipe_id WHERE NOT s.selfish),
asked AS (SELECT recipe_id AS r, item_id AS y, amount AS q FROM cin, n WHERE item_id <= n_parts + n_supp),
ways AS (SELECT a.r, a.y, m.recipe_id AS w, ((q + m.anchor_amt - 1) // m.anchor_amt) AS t, m.cost AS m_cost FROM asked a JOIN sized m ON m.anchor = a.y),
u AS (SELECT r, y, w, item_id, sum(coef) AS u FROM (SELECT ways.r, y, w, item_id, coef FROM ways JOIN cnet ON cnet.recipe_id = ways.r UNION ALL SELECT ways.r, y, w, item_id, coef * t FROM ways JOIN cnet ON cnet.recipe_id = w) GROUP BY 1, 2, 3, 4),
idle AS (SELECT r, y, w FROM u GROUP BY 1, 2, 3 HAVING max(u) <= 0),
cases AS (SELECT x, sib.r, y, w, s, s_cost <= t * m_cost + r_cost AS cheap FROM ways JOIN csib sib ON sib.r = ways.r),
above AS (SELECT c.r, c.y, c.w, c.s FROM cases c JOIN u ON u.r = c.r AND u.y = c.y AND u.w = c.w LEFT JOIN cnet v ON v.recipe_id = c.s AND v.item_id = u.item_id WHERE u.u > coalesce(v.coef, 0)
  UNION SELECT c.r, c.y, c.w, c.s FROM cases c JOIN cnet v ON v.recipe_id = c.s LEFT JOIN u ON u.r = c.r AND u.y = c.y AND u.w = c.w AND u.item_id = v.item_id WHERE v.coef < 0 AND u.u IS NULL),
open AS (SELECT c.x, c.r, c.y, c.s FROM cases c LEFT JOIN idle i ON i.r = c.r AND i.y = c.y AND i.w = c.w LEFT JOIN above a ON a.r = c.r AND a.y = c.y AND a.w = c.w AND a.s = c.s WHERE i.r IS NULL AND (a.r IS NOT NULL OR NOT c.cheap))""") + "SELECT x::INT AS item_id, sib.r AS recipe_id, a.y::INT AS guard, sib.s AS dominator FROM csib sib JOIN asked a ON a.r = sib.r ANTI JOIN open o ON o.x = sib.x AND o.r = sib.r AND o.y = a.y AND o.s = sib.s"),
    "recipe_rows": _with(_NORMAL) + "SELECT recipe_id, (row_number() OVER (ORDER BY recipe_id) - 1)::BIGINT AS row FROM canon",
    "mark_counts": _BY + "SELECT (SELECT count(*) FROM canon) AS recipes, (SELECT count(*) FROM (SELECT item_id FROM outputs WHERE recipe_id IN (SELECT recipe_id FROM canon) GROUP BY 1 HAVING count(DISTINCT recipe_id) > 1)) AS items_with_choice, (SELECT count(DISTINCT recipe_id) FROM pairs) AS directly_dominated, (SELECT count(DISTINCT recipe_id) FROM unit) AS dominated_a_unit",
    "graph_summary": "WITH " + derived.BYPRODUCTS.strip() + """, i AS (SELECT item_id FROM outputs UNION SELECT item_id FROM inputs), e AS (SELECT (SELECT count(*) FROM outputs) AS output_edges, (SELECT count(*) FROM inputs) AS input_edges, (SELECT count(*) FROM stations) AS station_edges)
SELECT (SELECT count(*) FROM i, n WHERE item_id <= n_parts + n_supp) AS items, (SELECT count(*) FROM i, n WHERE item_id > n_parts + n_supp) AS tags, (SELECT count(*) FROM recipes WHERE recipe_id >= 0) AS recipes, (SELECT count(*) FROM recipes WHERE recipe_id < 0) AS tag_edges, e.*, round(input_edges / (SELECT count(*) FROM recipes), 6) AS inputs_a_recipe FROM e""",
    "repaired_marks": _with() + "SELECT recipe_id FROM recipes r WHERE anchor_amt < 30 AND recipe_id >= 0 AND NOT (recipe_id = (SELECT min(recipe_id) FROM recipes s WHERE s.anchor = r.anchor) AND (SELECT max(anchor_amt) FROM recipes s WHERE s.anchor = r.anchor) < 30)",
    "usable_marks": _with(_NORMAL) + "SELECT (s.item_id % 3)::INT AS query_id, count(DISTINCT m.recipe_id) AS n_recipes FROM marked m JOIN cstations s ON s.recipe_id = dominator GROUP BY 1",
    "tag_budget": _with() + "SELECT tag::INT AS tag, k, pairs::BIGINT AS pairs, pairs <= 100000 AND k <= 1024 AS admitted FROM (SELECT tag, k, sum(k * k) OVER (ORDER BY k, tag) AS pairs FROM (SELECT tag, count(*) AS k FROM tags GROUP BY 1))",
    "exclusive_items": _with() + "SELECT member::INT AS item_id, tag::INT AS tag FROM tags WHERE tag IN (SELECT item_id FROM inputs WHERE recipe_id >= 0) AND member NOT IN (SELECT item_id FROM inputs WHERE recipe_id >= 0)",
    "tag_exclusive": _with("""
ex AS (SELECT member AS item_id, tag FROM tags WHERE tag IN (SELECT item_id FROM inputs WHERE recipe_id >= 0) AND member NOT IN (SELECT item_id FROM inputs WHERE recipe_id >= 0)),
paid AS (SELECT r.recipe_id, e.tag, r.anchor_amt, sum(i.amount) AS paid FROM recipes r JOIN ex e ON e.item_id = r.anchor JOIN inputs i ON i.recipe_id = r.recipe_id LEFT JOIN tags m ON m.member = i.item_id WHERE r.recipe_id >= 0 AND (m.tag = e.tag OR i.item_id = e.tag) GROUP BY 1, 2, 3)""") + "SELECT recipe_id, tag::INT AS tag FROM paid WHERE anchor_amt <= paid",
    "closed_islands": _with("""
targets AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) t(query_id, item_id)),
edges AS (SELECT DISTINCT o.item_id, i.item_id AS other FROM outputs o JOIN inputs i USING (recipe_id)),
needed AS (SELECT query_id, item_id FROM targets UNION SELECT w.query_id, e.other FROM needed w JOIN edges e USING (item_id)),
touches AS (SELECT recipe_id, item_id FROM outputs UNION SELECT recipe_id, item_id FROM inputs),
sizes AS (SELECT recipe_id, count(*) AS n FROM touches GROUP BY 1),
hit AS (SELECT query_id, recipe_id, count(*) AS hits FROM needed JOIN touches USING (item_id) GROUP BY 1, 2)""", recursive=True) + "SELECT query_id::INT AS query_id, count(*) AS n_recipes FROM hit JOIN sizes USING (recipe_id) WHERE hits = n GROUP BY 1",
    "cost_bounds": _with() + "SELECT item_id::BIGINT AS query_id, min(((100 + coef - 1) // coef) * cost)::BIGINT AS bound FROM (SELECT recipe_id, item_id, sum(x)::BIGINT AS coef FROM (SELECT recipe_id, item_id, amount AS x FROM outputs UNION ALL SELECT recipe_id, item_id, -amount FROM inputs) GROUP BY 1, 2) JOIN recipes USING (recipe_id) WHERE coef > 0 GROUP BY 1",
    "component_of_first": _with("""
edges AS (SELECT DISTINCT o.item_id AS a, i.item_id AS b FROM outputs o JOIN inputs i USING (recipe_id)),
down AS (SELECT 1::BIGINT AS item_id UNION SELECT e.b FROM down d JOIN edges e ON e.a = d.item_id),
up AS (SELECT 1::BIGINT AS item_id UNION SELECT e.a FROM up d JOIN edges e ON e.b = d.item_id)""", recursive=True) + "SELECT item_id::INT AS item_id FROM down JOIN up USING (item_id)",
    "inventories": "SELECT p_brand, count(*) FILTER (p_partkey % 8 IN (0, 7)) AS bad, sum(p_size) FILTER (p_partkey % 8 NOT IN (0, 7))::BIGINT AS amount FROM part GROUP BY 1",
    "report_summary": """WITH truth AS (SELECT o_custkey, min(o_orderkey) % 2 = 0 AS true_feasible, min(o_totalprice) AS best_cost FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
r AS (SELECT o.*, true_feasible, best_cost, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 101 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 103 ELSE 1 END AS ms FROM orders o LEFT JOIN truth USING (o_custkey))
SELECT o_orderpriority AS config, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS feasible, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS proven, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS unproven, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS no_answer, count(*) FILTER (o_orderstatus IN ('O', 'F') AND true_feasible IS NOT NULL) AS compared, count(*) FILTER (o_orderstatus IN ('O', 'F') AND (o_orderstatus = 'O') = true_feasible) AS agree, count(*) FILTER (o_orderstatus = 'O' AND NOT true_feasible) AS false_positive, median(ms)::DOUBLE AS plan_ms, round(median(CASE WHEN o_orderstatus = 'O' AND best_cost > 0 THEN o_totalprice / best_cost END), 6)::DOUBLE AS cost_ratio FROM r GROUP BY 1""",
}
