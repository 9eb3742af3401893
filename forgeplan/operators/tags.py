"""Tags: items that any of their members can stand for, through free edges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import Graph
from .normalize import stored


def members(g: Graph) -> DataFrame:
    """(tag, recipe_id, member) of every tag that is simple: its producers have no station and take one unit of one real item."""
    edges = g.outputs.where(F.col("item_id") > g.n_real).select(F.col("item_id").alias("tag"), "recipe_id")
    taken = g.inputs.groupBy("recipe_id").agg(F.count("*").alias("n"), F.first("item_id").alias("member"), F.first("amount").alias("taken"))
    worked = g.stations.select("recipe_id", F.lit(True).alias("worked")).distinct()
    all_ = edges.join(taken, "recipe_id", "left").join(worked, "recipe_id", "left")
    plain = F.coalesce((F.col("n") == 1) & (F.col("taken") == 1) & (F.col("member") <= g.n_real), F.lit(False)) & F.col("worked").isNull()
    simple = all_.groupBy("tag").agg(F.min(plain).alias("simple")).where("simple").select("tag")
    return all_.join(simple, "tag", "left_semi").select("tag", "recipe_id", "member")


def _real_inputs(g: Graph) -> DataFrame:
    real = g.recipes.where(F.col("anchor") <= g.n_real).select("recipe_id")
    return g.inputs.join(real, "recipe_id", "left_semi")


def inline_single_members(g: Graph) -> Graph:
    """Tags of one member that a real recipe consumes give way to the member; amounts of the same item are added."""
    mem = members(g)
    one = mem.groupBy("tag").agg(F.count("*").alias("n"), F.first("member").alias("member")).where("n = 1").select(F.col("tag").alias("item_id"), "member")
    real = _real_inputs(g)
    used = one.join(real, "item_id", "left_semi")
    rest = g.inputs.join(g.recipes.where(F.col("anchor") > g.n_real), "recipe_id", "left_semi")
    new = real.join(used, "item_id", "left").groupBy("recipe_id", F.coalesce("member", "item_id").alias("item_id")).agg(F.sum("amount").alias("amount"))
    gone = mem.join(used.select(F.col("item_id").alias("tag")), "tag", "left_semi").select("recipe_id")
    return _without(replace(g, inputs=new.unionByName(rest), packed=None), gone)


def _without(g: Graph, gone: DataFrame) -> Graph:
    cut = lambda df: df.join(gone, "recipe_id", "left_anti")
    return stored(replace(g, recipes=cut(g.recipes), outputs=cut(g.outputs), inputs=cut(g.inputs), stations=cut(g.stations), packed=None))


def inline_single_uses(g: Graph) -> Graph:
    """A tag of several members that one recipe consumes, one unit of it, is opened: the recipe has a copy for each member.

    The lowest tag of a recipe is opened, one a recipe. Copies take ids below all others, by recipe and member.
    """
    mem = members(g)
    many = mem.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1")
    uses = g.inputs.where(F.col("item_id") > g.n_real).groupBy("item_id").agg(F.count("*").alias("uses"), F.first("recipe_id").alias("recipe_id"), F.first("amount").alias("amount")).where("uses = 1 AND amount = 1")
    real = g.recipes.where(F.col("anchor") <= g.n_real)
    chosen = uses.join(many, uses["item_id"] == many["tag"]).join(real.select("recipe_id"), "recipe_id", "left_semi").groupBy("recipe_id").agg(F.min("tag").alias("tag"))
    copies = stored_copies(g, chosen.join(mem.select("tag", "member"), "tag"))
    of = lambda df: df.join(copies.select("recipe_id", "new"), "recipe_id")
    renamed = lambda df: df.drop("recipe_id").withColumnRenamed("new", "recipe_id")
    kept = g.inputs.join(copies, "recipe_id").where("item_id <> tag").select("new", "item_id", "amount")
    added = copies.select("new", F.col("member").alias("item_id"), F.lit(1).cast("long").alias("amount"))
    inputs = kept.unionByName(added).groupBy("new", "item_id").agg(F.sum("amount").alias("amount"))
    gone = chosen.select("recipe_id").unionByName(mem.join(chosen.select("tag"), "tag", "left_semi").select("recipe_id")).distinct()
    left = _without(g, gone)
    both = lambda old, new: old.unionByName(renamed(new).select(*old.columns))
    return stored(replace(left, recipes=both(left.recipes, of(g.recipes)), outputs=both(left.outputs, of(g.outputs)), inputs=both(left.inputs, inputs), stations=both(left.stations, of(g.stations)), packed=None))


def stored_copies(g: Graph, pairs: DataFrame) -> DataFrame:
    """(recipe_id, tag, member, new): ids spread over each recipe's own range, so no global numbering is needed."""
    low = g.recipes.agg(F.coalesce(F.min("recipe_id"), F.lit(0)), F.coalesce(F.max("recipe_id"), F.lit(0))).first()
    width = pairs.groupBy("recipe_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    rank = F.row_number().over(Window.partitionBy("recipe_id").orderBy("member"))
    return pairs.withColumn("new", F.lit(min(low[0], 0) - 1) - (F.col("recipe_id") - low[0]) * width - (rank - 1))


def drop_unused_items(g: Graph, targets: DataFrame) -> DataFrame:
    """(item_id) that a recipe mentions, and the targets."""
    return g.outputs.select("item_id").unionByName(g.inputs.select("item_id")).unionByName(targets.select("item_id")).distinct()


def within_budget(g: Graph, max_members: int = 1024, max_pairs: int = 4_000_000) -> DataFrame:
    """(tag, k, pairs, admitted): tags are admitted smallest first while the squares of their sizes fit the budget.

    One row a tag reaches the window, which is the catalogue's list of tags and not its edges.
    """
    sizes = members(g).groupBy("tag").agg(F.count("*").alias("k"))
    total = F.sum(F.col("k") * F.col("k")).over(Window.orderBy("k", "tag"))
    return sizes.withColumn("pairs", total).withColumn("admitted", (F.col("pairs") <= max_pairs) & (F.col("k") <= max_members))


def exclusive_items(g: Graph) -> DataFrame:
    """(item_id, tag) of real items that nothing but the edges of one simple, really consumed tag consumes."""
    mem = members(g)
    consumed = _real_inputs(g).select(F.col("item_id").alias("tag")).distinct()
    fed = mem.join(consumed, "tag", "left_semi")
    eaten = g.inputs.where(F.col("item_id") <= g.n_real).select("item_id", "recipe_id").join(fed.select("recipe_id", "tag"), "recipe_id", "left")
    one = eaten.groupBy("item_id").agg(F.count("*").alias("n"), F.count("tag").alias("fed"), F.countDistinct("tag").alias("tags"), F.first("tag", ignorenulls=True).alias("tag"))
    return one.where("n = fed AND tags = 1").select("item_id", "tag")


def tag_exclusive(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(recipe_id, tag) of real recipes that only turn members of a tag into no more of its exclusive members.

    What pays are inputs that are members of the tag and tags all of whose members are. Recipes that make one of
    `targets` (item_id) stay.
    """
    mem, exclusive = members(g), exclusive_items(g)
    real = g.recipes.where(F.col("anchor") <= g.n_real).select("recipe_id")
    made = g.outputs.join(real, "recipe_id", "left_semi").join(exclusive, "item_id", "left")
    made = made.groupBy("recipe_id").agg(F.count("*").alias("n"), F.count("tag").alias("e"), F.countDistinct("tag").alias("t"), F.first("tag", ignorenulls=True).alias("tag"), F.sum("amount").alias("made")).where("n = e AND t = 1")
    if targets is not None:
        made = made.join(g.outputs.join(targets, "item_id", "left_semi").select("recipe_id"), "recipe_id", "left_anti")
    own = mem.select("tag", F.col("member").alias("item_id")).distinct()
    size = own.groupBy("tag").agg(F.count("*").alias("size"))
    shared = own.alias("a").join(own.alias("b"), "item_id").groupBy(F.col("a.tag").alias("inner"), F.col("b.tag").alias("tag")).agg(F.count("*").alias("both"))
    inside = shared.join(size.withColumnRenamed("tag", "inner"), "inner").where("both = size").select("tag", F.col("inner").alias("item_id"))
    pays = own.unionByName(inside).distinct()
    paid = made.select("recipe_id", "tag").join(g.inputs, "recipe_id").join(pays, ["tag", "item_id"], "left_semi").groupBy("recipe_id").agg(F.sum("amount").alias("paid"))
    return made.join(paid, "recipe_id").where("made <= paid").select("recipe_id", "tag")
