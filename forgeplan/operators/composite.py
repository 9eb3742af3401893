"""Composite dominance: a recipe loses to a sibling once one of its inputs has to be made, whichever way that is done."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solver import strong_order
from ..plans.fixpoint import written
from ..sources.derived import Graph
from .normalize import cells, net, packed, stored

_KEY = ["recipe_id", "guard", "maker"]


def _possible(g: Graph, whole_batches: bool) -> DataFrame:
    """(recipe_id, guard, q) of real inputs that may prove something, judged by their amounts alone.

    With a maker of the input the sum u has some of it left over. Where that is above zero the sum is not idle, and a
    sibling must give as much of it: the most that any maker leaves is compared with the most that a maker of both
    items gives. Amounts are few and met as such, not asker by maker; inputs that nothing makes stay.
    """
    rows = packed(g)
    rows = rows.select("recipe_id", "outs", "ins", F.inline(F.array(F.struct(F.filter(cells(rows), lambda x: x["item_id"].isNotNull()).alias("whole")))))
    of = lambda i: F.coalesce(F.get(F.filter("whole", lambda x: x["item_id"] == i), F.lit(0))["coef"], F.lit(0))
    asked = rows.select("recipe_id", "outs", "whole", F.inline("ins")).where(F.col("item_id") <= g.n_real).select("recipe_id", F.col("item_id").alias("guard"), F.col("amount").alias("q"), of(F.col("item_id")).alias("own"), F.array_contains(F.col("outs")["item_id"], F.col("item_id")).alias("selfish"))
    made = rows.select("whole", F.inline("outs")).where(F.col("item_id") <= g.n_real).select(F.col("item_id").alias("guard"), F.col("amount").alias("p"), of(F.col("item_id")).alias("coef"))
    times = F.expr("(q + p - 1) div p" if whole_batches else "q div p")
    left = asked.select("guard", "q", "own").distinct().join(made.distinct(), "guard").groupBy("guard", "q", "own").agg(F.max(F.col("own") + times * F.col("coef")).alias("left"))
    asked = written(asked.join(left, ["guard", "q", "own"], "left"), "asked")
    gains = F.filter("whole", lambda x: (x["coef"] > 0) & (x["item_id"] <= g.n_real))
    room = rows.select(F.explode(F.filter("outs", lambda x: x["item_id"] <= g.n_real)["item_id"]).alias("x"), gains.alias("gains")).select("x", F.inline("gains"))
    room = written(room.where("x <> item_id").groupBy("x", F.col("item_id").alias("guard")).agg(F.max("coef").alias("room")), "room")
    cols = ["recipe_id", "guard", "q"]
    open_ = asked.where("left IS NULL OR left <= 0 OR selfish").select(*cols)
    if not room.isEmpty():  # only recipes of several outputs give room
        over = asked.where("left > 0 AND NOT selfish").join(g.outputs.select("recipe_id", F.col("item_id").alias("x")), "recipe_id")
        open_ = open_.unionByName(over.join(room, ["x", "guard"]).where("room >= left").select(*cols).distinct())
    return written(open_, "possible")


def composite_pairs(g: Graph, whole_batches: bool = True) -> DataFrame:
    """(item_id, recipe_id, guard, dominator): a sibling in making the item is no worse than the recipe with any maker of its input `guard`.

    The recipe and the maker's batches that its input needs are added up, item by item; the sum u is beaten by the
    sibling's column v if u <= v everywhere and it costs no less, and is idle if u <= 0. u <= v is counted, not
    compared pair by pair: all gains of u must be matched in v, and all losses of v in u, so columns only meet on
    items they share. A sibling that eats the item beats nothing; an input that nothing makes is beaten by all
    siblings. Inputs whose amounts rule out a proof (`_possible`) are left out before anything meets.
    """
    possible = _possible(g, whole_batches)
    losers = possible.select("recipe_id").distinct()
    made = g.outputs.where(F.col("item_id") <= g.n_real).select("item_id", "recipe_id")
    eats = g.inputs.select("item_id", "recipe_id")
    own = written(made.join(losers, "recipe_id", "left_semi"), "own")
    able = made.join(own.select("item_id").distinct(), "item_id", "left_semi").join(eats, ["item_id", "recipe_id"], "left_anti")
    siblings = written(own.join(able.withColumnRenamed("recipe_id", "dominator"), "item_id").where("recipe_id <> dominator"), "siblings")
    asked = possible.join(siblings.select("recipe_id").distinct(), "recipe_id", "left_semi")
    cost = g.recipes.select("recipe_id", "cost")
    makers = g.outputs.select(F.col("item_id").alias("guard"), F.col("recipe_id").alias("maker"), F.col("amount").alias("p"))
    n_makers = written(makers.join(asked.select("guard").distinct(), "guard", "left_semi").groupBy("guard").agg(F.count("*").alias("n_makers")), "n_makers")
    ways = asked.join(n_makers, "guard").join(makers, "guard").join(cost.select(F.col("recipe_id").alias("maker"), F.col("cost").alias("m_cost")), "maker").join(cost, "recipe_id")
    ways = ways.select(*_KEY, "n_makers", F.expr("(q + p - 1) div p" if whole_batches else "q div p").alias("times"), "m_cost", "cost")
    ways = written(ways.withColumn("u_cost", F.col("times") * F.col("m_cost") + F.col("cost")), "ways")
    met = ways.select("recipe_id").unionByName(ways.select(F.col("maker").alias("recipe_id"))).unionByName(siblings.select(F.col("dominator").alias("recipe_id"))).distinct()
    columns = written(net(replace(g, packed=packed(g).join(met, "recipe_id", "left_semi"))), "columns")
    parts = ways.join(columns, "recipe_id").select(*_KEY, F.col("item_id").alias("part"), "coef")
    parts = parts.unionByName(ways.join(columns.withColumnRenamed("recipe_id", "maker"), "maker").select(*_KEY, F.col("item_id").alias("part"), (F.col("coef") * F.col("times")).alias("coef")))
    u = written(parts.groupBy(*_KEY, "part").agg(F.sum("coef").alias("u")), "sums")
    gains = u.groupBy(*_KEY).agg(F.count_if(F.col("u") > 0).alias("gains"))
    idle = gains.where("gains = 0").select(*_KEY)
    v = columns.select(F.col("recipe_id").alias("dominator"), F.col("item_id").alias("part"), F.col("coef").alias("v"))
    losses = v.groupBy("dominator").agg(F.count_if(F.col("v") < 0).alias("losses"))
    met = u.join(siblings, "recipe_id").join(v, ["dominator", "part"])
    below = F.col("u") <= F.col("v")
    met = met.groupBy("item_id", *_KEY, "dominator").agg(F.count_if(below & (F.col("u") > 0)).alias("g"), F.count_if(below & (F.col("v") < 0)).alias("l"))
    beaten = met.join(gains, _KEY).join(losses, "dominator").where("g = gains AND l = losses").join(ways.select(*_KEY, "u_cost"), _KEY).join(cost.select(F.col("recipe_id").alias("dominator"), F.col("cost").alias("s_cost")), "dominator").where("s_cost <= u_cost")
    cases = ["item_id", *_KEY, "dominator"]
    proof = written(beaten.select(*cases), "beaten").unionByName(written(idle.join(siblings, "recipe_id").select(*cases), "idle")).distinct()
    every = proof.groupBy("item_id", "recipe_id", "guard", "dominator").agg(F.count("*").alias("n")).join(n_makers, "guard").where("n = n_makers")
    unmade = asked.join(n_makers, "guard", "left_anti").join(siblings, "recipe_id")
    cols = ["item_id", "recipe_id", "guard", "dominator"]
    return written(every.select(*cols), "every").unionByName(written(unmade.select(*cols), "unmade"))


def first_guards(pairs: DataFrame) -> DataFrame:
    """The pairs of the lowest guard of each recipe and item."""
    low = pairs.groupBy("item_id", "recipe_id").agg(F.min("guard").alias("guard"))
    return pairs.join(low, ["item_id", "recipe_id", "guard"])


def representatives(pairs: DataFrame) -> DataFrame:
    """(item_id, recipe_id, kept): the recipes that stand for each dominated one.

    Among an item's makers the relation may have cycles; of each strong component that nothing outside beats the
    lowest recipe is kept, and stands for all that lead to it. Items are settled one after the other, each held by one task.
    """

    kind = dict(pairs.dtypes)

    def settled(item: int, links: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        names = sorted({r for link in links for r in link})
        place = {r: k for k, r in enumerate(names)}
        after: list[list[int]] = [[] for _ in names]
        for a, b in links:
            after[place[a]].append(place[b])
        group, ends = {}, []
        for k, members in enumerate(strong_order(len(names), after)):
            group |= dict.fromkeys(members, k)
            beyond = {group[w] for m in members for w in after[m]} - {k}
            ends.append(set().union(*(ends[b] for b in beyond)) if beyond else {min(members)})
        return [(item, names[v], names[e]) for v in range(len(names)) for e in sorted(ends[group[v]]) if e != v]

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["item_id", "recipe_id", "kept"])
        item, links = None, []
        for df in frames:
            out = []
            for x, a, b in zip(df["item_id"].tolist(), df["recipe_id"].tolist(), df["dominator"].tolist()):
                if x != item and links:
                    out += settled(item, links)
                    links = []
                item = x
                links.append((a, b))
            yield frame(out)
        if links:
            yield frame(settled(item, links))

    dealt = pairs.select("item_id", "recipe_id", "dominator").repartition("item_id").sortWithinPartitions("item_id")
    return dealt.mapInPandas(resolve, f"item_id {kind['item_id']}, recipe_id {kind['recipe_id']}, kept {kind['recipe_id']}")


def composite_marks(g: Graph, whole_batches: bool = True) -> DataFrame:
    """(recipe_id, guard, stations) of the recipes that lose; a recipe that loses for several items has the last one's.

    Of items all of whose makers lose the first is given back.
    """
    from .dominance import repaired

    pairs = first_guards(composite_pairs(stored(g), whole_batches))
    kept = representatives(pairs).withColumnRenamed("recipe_id", "loser")
    at = kept.join(g.stations.withColumnRenamed("item_id", "station"), F.col("kept") == F.col("recipe_id")).groupBy("item_id", F.col("loser").alias("recipe_id")).agg(F.array_sort(F.collect_set("station")).alias("stations"))
    marks = kept.select("item_id", F.col("loser").alias("recipe_id")).distinct().join(pairs.select("item_id", "recipe_id", "guard").distinct(), ["item_id", "recipe_id"]).join(at, ["item_id", "recipe_id"], "left")
    marks = marks.groupBy("recipe_id").agg(F.max_by(F.struct("guard", "stations"), "item_id").alias("m")).select("recipe_id", "m.guard", F.coalesce("m.stations", F.array().cast("array<int>")).alias("stations"))
    return repaired(g, marks)


def droppable(marks: DataFrame, stations: DataFrame, stock: DataFrame) -> DataFrame:
    """(query_id, recipe_id) of marks that hold for a request: the guard is not in stock and a station is at hand."""
    at = marks.select("recipe_id", "guard", F.explode("stations").alias("item_id")).join(stations, "item_id").select("query_id", "recipe_id", "guard").distinct()
    return at.join(stock.where("amount > 0").select("query_id", F.col("item_id").alias("guard")).distinct(), ["query_id", "guard"], "left_anti").select("query_id", "recipe_id")
