"""What the planner writes: result rows, dumps, manifests and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalize import net
from ..plans.fixpoint import written
from ..sources.derived import Graph


def renumbered(g: Graph) -> DataFrame:
    """(recipe_id, row): recipes numbered from 0 in the order of their ids. Ranges of ids are numbered each for itself, after the counts of those before."""
    ranges = written(g.recipes.select("recipe_id").repartitionByRange("recipe_id").withColumn("part", F.spark_partition_id()), "ranges")
    counts, before, offsets = sorted(ranges.groupBy("part").agg(F.count("*").alias("n")).collect()), 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    rank = F.row_number().over(Window.partitionBy("part").orderBy("recipe_id"))
    numbered = ranges.join(F.broadcast(ranges.sparkSession.createDataFrame(offsets, "part int, before long")), "part")
    return numbered.select("recipe_id", (F.col("before") + rank - 1).cast("long").alias("row"))


def coefficients(g: Graph, cells: DataFrame) -> DataFrame:
    """`cells` (recipe_id, item_id) with what the recipe gives of the item less what it takes, 0 where it has none."""
    return cells.join(net(g), ["recipe_id", "item_id"], "left").na.fill(0, ["coef"])


def mark_counts(g: Graph, marks: dict[str, DataFrame]) -> DataFrame:
    """One row: recipes, items that several recipes make, and the recipes under each kind of marks (recipe_id)."""
    makers = g.outputs.groupBy("item_id").agg(F.countDistinct("recipe_id").alias("n"))
    row = g.recipes.agg(F.count("*").alias("recipes")).crossJoin(makers.agg(F.count_if(F.col("n") > 1).alias("items_with_choice")))
    for name, df in marks.items():
        row = row.crossJoin(df.agg(F.countDistinct("recipe_id").alias(name)))
    return row


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines, nulls included, so every line has every field."""
    rows.write.option("ignoreNullFields", "false").json(path)


def dumped(g: Graph) -> DataFrame:
    """(recipe_id, anchor, anchor_amt, cost, outputs, inputs, stations): a graph as one row a recipe, lists in order of items."""
    pairs = lambda df, name: df.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "amount"))).alias(name))
    at = g.stations.groupBy("recipe_id").agg(F.array_sort(F.collect_set("item_id")).alias("stations"))
    return g.recipes.join(pairs(g.outputs, "outputs"), "recipe_id", "left").join(pairs(g.inputs, "inputs"), "recipe_id", "left").join(at, "recipe_id", "left")


def write_dump(g: Graph, path: str) -> None:
    dumped(g).write.json(path)


def summary(g: Graph) -> DataFrame:
    """One row: counts of items, tags, recipes and edges, and edges a recipe."""
    items = g.outputs.select("item_id").unionByName(g.inputs.select("item_id")).distinct()
    row = items.agg(F.count_if(F.col("item_id") <= g.n_real).alias("items"), F.count_if(F.col("item_id") > g.n_real).alias("tags"))
    row = row.crossJoin(g.recipes.agg(F.count_if(F.col("anchor") <= g.n_real).alias("recipes"), F.count_if(F.col("anchor") > g.n_real).alias("tag_edges")))
    for name, df in (("output_edges", g.outputs), ("input_edges", g.inputs), ("station_edges", g.stations)):
        row = row.crossJoin(df.agg(F.count("*").alias(name)))
    return row.withColumn("inputs_a_recipe", F.col("input_edges") / F.greatest(F.col("recipes") + F.col("tag_edges"), F.lit(1)))


def _lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One tab-separated line a row; lists are comma-joined, nulls empty."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")
    return df.select(F.concat_ws("\t", *(F.coalesce(text(c), F.lit("")) for c in columns)).alias("value"))


def write_targets(targets: DataFrame, path: str) -> None:
    """(handle, name, amounts, n_recipes, in_big_scc) as `tables.targets` reads them."""
    _lines(targets, ["handle", "name", "amounts", "n_recipes", "in_big_scc"]).write.text(path)


def write_stock(stock: DataFrame, path: str) -> None:
    """(item_id, amount) as `tables.stock` reads them."""
    _lines(stock, ["item_id", "amount"]).write.text(path)


def write_report(rows: DataFrame, path: str, order: list[str] | None = None, by: str = "config") -> None:
    """A report table as CSV with a header, rows in the given order of `by` (others after them, by name)."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(by)) if order else F.lit(0)
    rows.orderBy(F.when(place > 0, place).otherwise(F.lit(1 << 30)), by).coalesce(1).write.option("header", "true").csv(path)
