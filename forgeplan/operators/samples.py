"""Seeded samples of targets, stock and stations. The catalogue's list of items is on the driver; draws repeat exactly."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import Graph


def _listed(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("item_id").distinct().orderBy("item_id").toLocalIterator()]


def targets(g: Graph, count: int, seed: int, inside: DataFrame | None = None, outside: int = 0) -> DataFrame:
    """(item_id) of `count` produced real items; with `inside` (item_id) that many of those, and `outside` others."""
    made = g.outputs.where(F.col("item_id") <= g.n_real)
    draw = random.Random(f"{seed}:targets")
    if inside is None:
        pool = _listed(made)
        chosen = draw.sample(pool, min(count, len(pool)))
    else:
        chosen = draw.sample(_listed(made.join(inside, "item_id", "left_semi")), count) + draw.sample(_listed(made.join(inside, "item_id", "left_anti")), outside)
    return g.recipes.sparkSession.createDataFrame([(int(x),) for x in sorted(chosen)], "item_id int")


def random_stock(g: Graph, seed: int, fraction: float = 0.2, least: int = 1, most: int = 100_000) -> DataFrame:
    """(item_id, amount) for a share of the real items; the logarithms of the amounts are uniform."""
    draw = random.Random(f"{seed}:random20")
    chosen = sorted(draw.sample(range(1, g.n_real + 1), round(fraction * g.n_real)))
    amount = lambda: max(least, round(least * (most / least) ** draw.random())) if most > least else least
    return g.recipes.sparkSession.createDataFrame([(h, amount()) for h in chosen], "item_id int, amount long")


def leaf_stock(g: Graph, amount: int = 1_000_000) -> DataFrame:
    """(item_id, amount) for every real item that nothing makes."""
    return g.inputs.where(F.col("item_id") <= g.n_real).select("item_id").distinct().join(g.outputs, "item_id", "left_anti").withColumn("amount", F.lit(amount).cast("long"))


def _stream(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the splitmix64 sequence."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stations(g: Graph, names: DataFrame, fraction: float, seed: int, always: str = "minecraft:") -> DataFrame:
    """(item_id) of the stations whose id starts with `always`, and of a share of the other stations."""
    spark = g.recipes.sparkSession
    if fraction >= 1:
        return spark.range(1, g.n_real + 1).select(F.col("id").cast("int").alias("item_id"))
    base = names.where(F.startswith("resource_id", F.lit(always))).select(F.col("handle").alias("item_id"))
    kept, pool = _listed(g.stations.join(base, "item_id", "left_semi")), _listed(g.stations.join(base, "item_id", "left_anti"))
    want = min(len(pool), int(fraction * len(pool) + 0.5))
    for i, x in enumerate(_stream(seed or 1, want).tolist()):
        j = i + x % (len(pool) - i)
        pool[i], pool[j] = pool[j], pool[i]
    return spark.createDataFrame([(int(x),) for x in sorted(kept + pool[:want])], "item_id int")
