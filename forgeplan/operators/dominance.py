"""Direct dominance among recipes of one item: S beats R if its column is no less in any item, and it costs no more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from ..sources.derived import Graph
from .composite import representatives
from .normalize import cells, packed


#: Makers of one item up to which all meet all; of more, a recipe only meets those that lose what it loses.
FEW = 1024


def makers(g: Graph) -> DataFrame:
    """(item_id, recipe_id, out, cost, able, net, n_gains, n_losses, gains, losses, lost): the makers of every real item.

    `net` maps items to what a recipe gives less what it takes, zeros left out; `lost` are the items that it loses;
    `gains` and `losses` have a bit for each item, by its hash. A maker is able to dominate if it does not consume the item.
    """
    rows = packed(g)
    whole = F.filter(cells(rows), lambda x: x["coef"] != 0)
    whole = F.transform(whole, lambda x: F.struct(F.coalesce(x["item_id"], F.lit(0)).alias("item_id"), x["coef"].alias("coef")))
    eaten = F.transform(F.filter("ins", lambda x: x["amount"] > 0), lambda x: x["item_id"])
    rows = rows.select("recipe_id", "cost", "outs", F.inline(F.array(F.struct(whole.alias("whole"), eaten.alias("eaten")))))  # worked out once a row
    signed = rows.select("*", F.inline(F.array(F.struct(F.filter("whole", lambda x: x["coef"] > 0)["item_id"].alias("won"), F.filter("whole", lambda x: x["coef"] < 0)["item_id"].alias("lost")))))
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(i), F.lit(64)).cast("int"))))
    rows = signed.select("recipe_id", "cost", "eaten", F.map_from_entries("whole").alias("net"), F.size("won").alias("n_gains"), F.size("lost").alias("n_losses"), bits("won").alias("gains"), bits("lost").alias("losses"), "lost", F.inline("outs"))
    able = ~F.coalesce(F.array_contains("eaten", F.col("item_id")), F.lit(False))
    return written(rows.where(F.col("item_id") <= g.n_real).withColumn("able", able).withColumnRenamed("amount", "out").drop("eaten"), "makers")


def _met(g: Graph, compare: Callable[[Column, Column], Column], strict: bool, *also: Column, few: int, rows: DataFrame | None) -> DataFrame:
    """(item_id, recipe_id, dominator): makers of one real item whose columns the dominator covers.

    A column holds what a recipe gives less what it takes, byproducts included. R <= S everywhere needs all gains of R
    among those of S, and all losses of S among those of R; pairs whose counts and bits allow it are compared whole.
    `compare` gives R's and S's sides of the comparison for their coefficients; with `strict` the columns must differ.
    A dominator costs no more and does not consume the item itself. Of an item of more than `few` makers S is only met by recipes
    that lose the item which the fewest of its makers lose among those that S loses, or by all if S loses none: no pair is left out. `rows` are those of `makers`.
    """
    rows = makers(g) if rows is None else rows
    light = ["item_id", "recipe_id", "cost", "out", "net", "n_gains", "n_losses", "gains", "losses"]
    many = written(g.outputs.where(F.col("item_id") <= g.n_real).groupBy("item_id").agg(F.count("*").alias("k")).where(F.col("k") > few).select("item_id"), "many")
    if many.isEmpty():
        r, s, slot = rows.select(*light).alias("r"), rows.where("able").select(*light).alias("s"), F.lit(True)
    else:
        plain = rows.join(many, "item_id", "left_anti").withColumn("slot", F.lit(0))
        big = written(rows.join(many, "item_id", "left_semi"), "big")
        losers = big.select("item_id", F.explode("lost").alias("slot")).groupBy("item_id", "slot").agg(F.count("*").alias("n"))
        rarest = big.where("able").select("item_id", "recipe_id", F.explode("lost").alias("slot")).join(losers, ["item_id", "slot"]).groupBy("item_id", "recipe_id").agg(F.min_by("slot", F.struct("n", "slot")).alias("slot"))
        r = plain.select(*light, "slot").unionByName(big.select(*light, F.explode(F.concat("lost", F.array(F.lit(-1)))).alias("slot"))).alias("r")
        s = plain.where("able").select(*light, "slot").unionByName(big.where("able").join(rarest, ["item_id", "recipe_id"], "left").select(*light, F.coalesce("slot", F.lit(-1)).alias("slot"))).alias("s")
        slot = F.col("r.slot") == F.col("s.slot")
    may = (F.col("r.item_id") == F.col("s.item_id")) & slot & (F.col("r.recipe_id") != F.col("s.recipe_id")) & (F.col("s.cost") <= F.col("r.cost"))
    for extra in also:
        may &= extra
    may &= (F.col("r.n_gains") <= F.col("s.n_gains")) & (F.col("s.n_losses") <= F.col("r.n_losses"))
    may &= (F.col("r.gains").bitwiseAND(F.bitwise_not("s.gains")) == 0) & (F.col("s.losses").bitwiseAND(F.bitwise_not("r.losses")) == 0)
    none = F.lit(0).cast("long")
    of = lambda side, i: F.coalesce(F.try_element_at(F.col(f"{side}.net"), i), none)
    within = lambda test, v, w: test(*compare(v, w))
    no_more, less = (lambda v, w: v <= w), (lambda v, w: v < w)
    mine, its = F.map_entries("r.net"), F.map_entries("s.net")
    covered = F.forall(mine, lambda x: within(no_more, x["value"], of("s", x["key"]))) & F.forall(its, lambda y: within(no_more, of("r", y["key"]), y["value"]))
    differ = F.exists(mine, lambda x: within(less, x["value"], of("s", x["key"]))) | F.exists(its, lambda y: within(less, of("r", y["key"]), y["value"]))
    met = r.join(s, may & covered & differ if strict else may & covered)
    return met.select(F.col("r.item_id").alias("item_id"), F.col("r.recipe_id").alias("recipe_id"), F.col("s.recipe_id").alias("dominator"))


def direct_pairs(g: Graph, few: int = FEW, rows: DataFrame | None = None) -> DataFrame:
    """(item_id, recipe_id, dominator): one run of the dominator stands in for one of the recipe, and makes no less of the item."""
    return _met(g, lambda v, w: (v, w), False, F.col("r.out") <= F.col("s.out"), few=few, rows=rows)


def per_unit_pairs(g: Graph, few: int = FEW, rows: DataFrame | None = None) -> DataFrame:
    """(item_id, recipe_id, dominator) where the dominator's column is no less for one unit of the item, and more in something.

    Coefficients are compared crosswise as DECIMAL(38,0), so no ratio is rounded; a run costs no more, as it is. Equal
    columns of different batches beat each other nowhere.
    """
    big = lambda c: c.cast("decimal(19,0)")
    return _met(g, lambda v, w: (big(v) * big(F.col("s.out")), big(w) * big(F.col("r.out"))), True, few=few, rows=rows)


def direct_marks(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(recipe_id, n_dominators, stations) of the dominated recipes; one that loses for several items has the last one's.

    The recipes that nothing beats, and the lowest one of each set of equals, stand for those that they beat.
    """
    kept = representatives(direct_pairs(g) if pairs is None else pairs).withColumnRenamed("recipe_id", "loser")
    at = kept.join(packed(g).select(F.col("recipe_id").alias("kept"), F.sort_array("stations").alias("stations")), "kept", "left")
    marks = at.groupBy("item_id", F.col("loser").alias("recipe_id")).agg(F.count("*").alias("n_dominators"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("stations")))).alias("stations"))
    return marks.groupBy("recipe_id").agg(F.max_by(F.struct("n_dominators", "stations"), "item_id").alias("m")).select("recipe_id", "m.n_dominators", "m.stations")


def direct_dominance(g: Graph) -> DataFrame:
    """(recipe_id, n_dominators, n_stations) of the dominated recipes."""
    return direct_marks(g).select("recipe_id", "n_dominators", F.size("stations").cast("long").alias("n_stations"))


def repaired(g: Graph, marked: DataFrame) -> DataFrame:
    """`marked` (recipe_id) without the first producer of every real item whose producers are all marked."""
    flags = g.outputs.where(F.col("item_id") <= g.n_real).join(marked.select("recipe_id", F.lit(True).alias("m")), "recipe_id", "left")
    dead = flags.groupBy("item_id").agg(F.count("m").alias("m"), F.count("*").alias("n"), F.min("recipe_id").alias("recipe_id")).where("m = n")
    return marked.join(dead, "recipe_id", "left_anti")


def usable(marks: DataFrame, stations: DataFrame) -> DataFrame:
    """(query_id, recipe_id) of `marks` (recipe_id, stations) that a request may drop: one of their stations is at hand."""
    at = marks.select("recipe_id", F.explode("stations").alias("item_id"))
    return at.join(stations, "item_id").select("query_id", "recipe_id").distinct()
