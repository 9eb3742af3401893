"""Normalisation of a recipe graph: recipes are one row each, and every step but the merging of equals stays within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from ..sources.derived import Graph


def packed(g: Graph) -> DataFrame:
    """(recipe_id, anchor, anchor_amt, cost, outs, ins, stations): pairs (item_id, amount) and stations as arrays, never null."""
    if g.packed is not None:
        return g.packed
    pairs = lambda df, name: df.groupBy("recipe_id").agg(F.collect_list(F.struct("item_id", "amount")).alias(name))
    kind = lambda df: f"array<struct<item_id:{dict(df.dtypes)['item_id']},amount:{dict(df.dtypes)['amount']}>>"
    at = g.stations.groupBy("recipe_id").agg(F.collect_set("item_id").alias("stations"))
    rows = g.recipes.join(pairs(g.outputs, "outs"), "recipe_id", "left").join(pairs(g.inputs, "ins"), "recipe_id", "left").join(at, "recipe_id", "left")
    full = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.select("recipe_id", "anchor", "anchor_amt", "cost", full("outs", kind(g.outputs)), full("ins", kind(g.inputs)), full("stations", f"array<{dict(g.stations.dtypes)['item_id']}>"))


def unpacked(n_real: int, rows: DataFrame) -> Graph:
    pairs = lambda c: rows.select("recipe_id", F.inline(c))
    return Graph(n_real, rows.select("recipe_id", "anchor", "anchor_amt", "cost"), pairs("outs"), pairs("ins"), rows.select("recipe_id", F.explode("stations").alias("item_id")), rows)


def stored(g: Graph) -> Graph:
    """The graph written and read back, one row a recipe: later steps read it many times over."""
    return unpacked(g.n_real, written(packed(g), "recipes"))


def drop_non_positive_inputs(g: Graph) -> Graph:
    return unpacked(g.n_real, packed(g).withColumn("ins", F.filter("ins", lambda x: x["amount"] > 0)))


def _amount(pairs: Column, item: Column) -> Column:
    """What `pairs` have of `item`, 0 if nothing."""
    return F.aggregate(F.filter(pairs, lambda x: x["item_id"].eqNullSafe(item)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["amount"], F.lit(0)))


def cells(rows: DataFrame) -> Column:
    """Of packed rows: (item_id, coef) for every item that a recipe gives or takes, outputs less inputs."""
    outs, ins = F.col("outs"), F.col("ins")
    items = F.array_distinct(F.concat(outs["item_id"], ins["item_id"]))
    cell = lambda item, coef: F.struct(item.alias("item_id"), coef.alias("coef"))
    once = F.concat(F.transform(outs, lambda x: cell(x["item_id"], F.coalesce(x["amount"], F.lit(0)))), F.transform(ins, lambda x: cell(x["item_id"], -F.coalesce(x["amount"], F.lit(0)))))
    return F.when(F.size(items) == F.size(outs) + F.size(ins), once).otherwise(F.transform(items, lambda i: cell(i, _amount(outs, i) - _amount(ins, i))))


def net(g: Graph, zeros: bool = False) -> DataFrame:
    """(recipe_id, item_id, coef): outputs less inputs, zeros left out unless asked for."""
    rows = packed(g)
    columns = rows.select("recipe_id", F.inline(cells(rows)))
    return columns if zeros else columns.where("coef <> 0")


def drop_useless(g: Graph) -> Graph:
    """Real recipes that gain none of their outputs, or have no station, go."""
    rows = packed(g)
    gains = F.exists("outs", lambda o: o["amount"] > _amount(F.col("ins"), o["item_id"]))
    real = (F.col("anchor") <= g.n_real) & gains & (F.size("stations") > 0)
    return unpacked(g.n_real, rows.where(real | (F.col("anchor") > g.n_real)))


def canonicalize(g: Graph) -> Graph:
    """Equal recipes, in anchor, cost and amounts, become the one with the lowest id, with the stations of all.

    The groups' hash stands first among the keys, so that sorting seldom looks at the arrays.
    """
    rows = packed(g).withColumns({"outs": F.sort_array("outs"), "ins": F.sort_array("ins")})
    same = ["anchor", "anchor_amt", "cost", "outs", "ins"]
    merged = rows.groupBy(F.xxhash64(*same).alias("hash"), *same).agg(F.min("recipe_id").alias("recipe_id"), F.array_distinct(F.flatten(F.collect_set(F.sort_array("stations")))).alias("stations"))
    return unpacked(g.n_real, merged.select("recipe_id", *same, "stations"))


def normalized(g: Graph) -> Graph:
    return stored(canonicalize(drop_useless(drop_non_positive_inputs(g))))
