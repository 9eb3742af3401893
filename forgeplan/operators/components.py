"""Strongly connected components of the item graph, and what lies around the largest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from ..sources.derived import Graph


def item_edges(g: Graph) -> DataFrame:
    """(a, b): a recipe that makes a consumes b."""
    made, used = g.outputs.select("recipe_id", F.col("item_id").alias("a")), g.inputs.select("recipe_id", F.col("item_id").alias("b"))
    return made.join(used, "recipe_id").select("a", "b").distinct()


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, colour) that follow from `seeds` along edges whose ends have one colour: edges (a, b, colour)."""
    front = seen = written(seeds.select("node", "colour"), "seen")
    while not front.isEmpty():
        near = front.join(edges, (F.col("node") == F.col("a")) & (front["colour"] == edges["colour"])).select(F.col("b").alias("node"), front["colour"]).distinct()
        front = written(near.join(seen, "node", "left_anti"), "front")
        seen = written(seen.unionByName(front), "seen")
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component), component being the largest node in it, for all ends of `edges` (a, b).

    Every node takes the largest number that reaches it; a node that keeps its own then claims, against the edges, the
    nodes of its colour. What is claimed is a component and leaves; nodes without a way in or out leave before.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    found = None
    add = lambda df: written(df if found is None else found.unionByName(df), "found")
    while not nodes.isEmpty():
        both = edges.select(F.col("a").alias("node")).intersect(edges.select(F.col("b").alias("node")))
        lone = written(nodes.join(both, "node", "left_anti").select("node", F.col("node").alias("component")), "lone")
        if lone.isEmpty():
            colour = written(nodes.select("node", F.col("node").alias("colour")), "colour")
            while True:
                push = edges.join(colour, F.col("a") == F.col("node")).groupBy("b").agg(F.max("colour").alias("pushed"))
                new = written(colour.join(push, F.col("node") == F.col("b"), "left").select("node", F.greatest("colour", F.coalesce("pushed", "colour")).alias("colour"), (F.coalesce("pushed", "colour") > F.col("colour")).alias("moved")), "colour")
                colour = new.drop("moved")
                if new.where("moved").isEmpty():
                    break
            c = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"c{end}"))
            back = written(edges.join(c("a"), "a").join(c("b"), "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("colour")), "back")
            lone = _spread(back, colour.where("node = colour")).select("node", F.col("colour").alias("component"))
        found = add(lone)
        nodes = written(nodes.join(lone, "node", "left_anti"), "nodes")
        edges = written(edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi"), "edges")
    return found if found is not None else nodes.select("node", F.col("node").alias("component"))


def statistics(g: Graph) -> DataFrame:
    """One row: components, items and recipes of the largest one, and the items above and below it.

    A recipe is in the component if it makes and consumes items of it. Above are items that need it, below those that
    it needs.
    """
    edges = written(item_edges(g), "edges")
    comp = written(strong_components(edges), "components")
    items = g.outputs.select(F.col("item_id").alias("node")).unionByName(g.inputs.select(F.col("item_id").alias("node"))).distinct()
    comp = items.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    comp = written(comp, "components")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    big = written(comp.join(F.broadcast(top), "component").select(F.col("node").alias("item_id")), "big")
    inside = g.outputs.join(big, "item_id", "left_semi").select("recipe_id").intersect(g.inputs.join(big, "item_id", "left_semi").select("recipe_id"))
    seeds = big.select(F.col("item_id").alias("node"), F.lit(0).alias("colour"))
    down, up = edges.withColumn("colour", F.lit(0)), edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("colour"))
    beyond = lambda e, name: _spread(e, seeds).agg(F.count("*").alias(name))
    row = sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest")).crossJoin(inside.agg(F.count("*").alias("recipes_in_largest")))
    row = row.crossJoin(beyond(down, "below")).crossJoin(beyond(up, "above"))
    return row.select("n_components", "largest", "recipes_in_largest", (F.col("below") - F.col("largest")).alias("below"), (F.col("above") - F.col("largest")).alias("above"))
