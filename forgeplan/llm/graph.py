"""Connected components of a link table, by alternating large-star and small-star rounds.

Tables of FEW links or less are united by one task instead: that is bounded work, and the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, looked_up


FEW = 1 << 20


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the ends of all links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[parent]
        p, q = p[apart], q[apart]
        low = np.minimum(p, q)
        np.minimum.at(parent, np.maximum(p, q), low)
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _one_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(p.column(0).to_numpy(), p.column(1).to_numpy()) for p in parts]
    if held:
        node, root = united(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _written(e: DataFrame) -> Stage:
    return Stage(e, "links", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"))


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node of its component.

    Each round is two grouped minima and joins, written to the shared folder. Links in a star about the smallest
    node are the fixed point; the number of rounds follows the logarithm of the longest chain, and no step
    gathers a component in one task: minima are combined before the shuffle, and the links of hot nodes, such as the
    centre of a large star, stay where they are and meet a broadcast copy of the node's minimum (`looked_up`).
    """
    start = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = _written(start)
    if now.measured["n"] <= few and dict(start.dtypes) == {"u": "bigint", "v": "bigint"}:
        return now.df.coalesce(1).mapInArrow(_one_task, "node long, root long")
    while now.measured["n"]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = now.measured["n"]
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = looked_up(both, low, "u", "n", 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, low, "u", "n", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where(F.col("u") != F.col("v")).distinct()
        after = _written(small)
        now.drop()
        now, done = after, after.measured == now.measured
        if done:
            break
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
