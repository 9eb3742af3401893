"""SimHash near-duplicates by a binary trie self-join.

Texts become 64-bit SimHash fingerprints of 4-word shingles. Two fingerprints link at `budget` or fewer differing
bits; documents of one connected component form a group.

The self-join walks pairs of nodes of a binary trie together: each level adds one bit, a pair whose halves differ
in it pays one error, and pairs beyond the budget are pruned. To spread one trie over a cluster, its bits are cut
into budget + 2 blocks: two fingerprints within the budget agree on two whole blocks at least, so for each choice of
two blocks the trie is reordered to have them on top, and every subtrie below such a top is walked on its own with
no error spent. Each distinct fingerprint is dealt out C(budget + 2, 2) times, whatever the corpus.

Links of a subtrie leave it as a star about its smallest fingerprint, never as all pairs; neighbours in trie order
are united first, and a node pair of one united run is not walked, so dense groups cost about a sort.

Ids may have any type that can be ordered and keep it. Cases: null or blank text has fingerprint zero and links like
any other; a text with fewer than four words is one shingle, a very long one is hashed in steps; a null id keeps its
row and never names a component; repeated ids and texts keep their rows; an empty table gives an empty table; other
columns are ignored by `near_duplicates`, and kept as they are by `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Stage, looked_up, staged, unused
from .graph import components

BITS = 64


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """SimHash of the XXH64 of all word shingles, ASCII letters lowered; a bit is set if over half of the shingles set it."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return digest(b" ".join(ws), seed)
    joined = b" ".join(ws)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), step):
        h = np.array([digest(joined[x:y], seed) for x, y in zip(starts[at : at + step], ends[at : at + step])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp holds the unsigned bits in a long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in part.column(2).cast(pa.binary())), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("fp", LongType())]))


def masks(budget: int) -> list[int]:
    """For each choice of two of budget + 2 blocks of bits, the bits of both."""
    n = budget + 2
    edges = [BITS * i // n for i in range(n + 1)]
    block = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:])]
    return [p | q for p, q in combinations(block, 2)]


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] with b[i] in `parent`, in place."""

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def trie_links(s: np.ndarray, mask: int, budget: int, chunk: int = 1 << 19, leaf: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for each value of a group of two or more linked values; `s`: distinct uint64 values.

    Values link only if they agree on the bits of `mask`, the top of this trie.
    """
    key, rest = s & np.uint64(mask), s & np.uint64(~mask & (2**BITS - 1))
    order = np.lexsort((rest, key))
    s, key = s[order], key[order]
    if len(s) < 2:
        return s[:0], s[:0]
    near = (key[1:] == key[:-1]) & (np.bitwise_count(s[1:] ^ s[:-1]) <= budget)
    label = np.concatenate([[0], np.cumsum(~near)])  # runs of neighbours that link
    parent = np.arange(label[-1] + 1)
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    lo, hi = bounds[:-1], bounds[1:]
    keep = (hi - lo > 1) & (label[lo] != label[hi - 1])
    lo, hi = lo[keep], hi[keep]
    bits = [i for i in range(BITS - 1, -1, -1) if not mask >> i & 1]
    ones: dict[int, np.ndarray] = {}
    work = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    while work:
        level, alo, ahi, blo, bhi, spent = work.pop()
        if len(alo) > chunk:
            half = len(alo) // 2
            work += [(level, *(x[half:] for x in (alo, ahi, blo, bhi, spent))), (level, *(x[:half] for x in (alo, ahi, blo, bhi, spent)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (level == len(bits))
        if small.any():  # a few values on either side, or whole values: compared directly
            x, y = alo[small], blo[small]
            w = bhi[small] - y
            n = (ahi[small] - x) * w
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, j = x[of] + k // w[of], y[of] + k % w[of]
            hit = (label[i] != label[j]) & (np.bitwise_count(s[i] ^ s[j]) <= budget)
            pairs = np.unique(np.stack([label[i[hit]], label[j[hit]]]), axis=1)
            _roots(parent, pairs[0], pairs[1])
            alo, ahi, blo, bhi, spent = (v[~small] for v in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            continue
        bit = bits[level]
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((s >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        c = ones[bit]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        parts = [(alo, am, blo, bm, spent), (am, ahi, bm, bhi, spent), (alo, am, bm, bhi, spent + 1), (am, ahi, blo, bm, spent + 1)]
        alo, ahi, blo, bhi, spent = (np.concatenate(v) for v in zip(*parts))
        mirrored = np.concatenate([np.zeros(3 * len(same), bool), same])
        keep = ~mirrored & (ahi > alo) & (bhi > blo) & (spent <= budget)
        keep[keep] &= ~((label[alo[keep]] == label[bhi[keep] - 1]) & (label[ahi[keep] - 1] == label[blo[keep]]))
        if keep.any():
            work.append((level + 1, *(v[keep] for v in (alo, ahi, blo, bhi, spent))))
    for x in range(len(parent)):  # parents are smaller, so one pass flattens
        parent[x] = parent[parent[x]]
    group = parent[label]
    size = np.bincount(group, minlength=len(parent))
    low = np.full(len(parent), 2**BITS - 1, np.uint64)
    np.minimum.at(low, group, s)
    many = size[group] > 1
    return s[many], low[group[many]]


def links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` wherever some chain of pairs within the budget does."""
    tops = masks(budget)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(p.column(0).to_numpy(), p.column(1).to_numpy()) for p in parts]
        if not held:
            return
        top, fp = (np.concatenate(x) for x in zip(*held))
        for t in np.unique(top):
            a, b = trie_links(fp[top == t].view(np.uint64), tops[t], budget)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (a, b)], schema=schema)

    signed = [m - 2**BITS if m >> (BITS - 1) else m for m in tops]
    rows = fps.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("top", "key"), "fp")
    return rows.repartition("top", "key").select("top", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of `docs`; root names components without any id, too."""
    made = Stage(fingerprints(docs, id_col, text_col, width), "fingerprints", F.count(F.lit(1)).alias("n"))
    classes = staged(made.df.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    roots = staged(components(links(classes.select("fp"), budget)), "components")
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_fps"))
    known = looked_up(joined.select("fp", "n", "root"), ids, "root", "n_fps", made.measured["n"])
    return looked_up(made.df, staged(known, "known"), "fp", "n", made.measured["n"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4) -> DataFrame:
    """`docs` with one row of each group, that of the smallest id (rows without one come last).

    Of rows with equal id and text one is kept, whichever.
    """
    rows = near_duplicates(docs, id_col, text_col, budget, width)
    own, hash_ = (unused(c, docs.columns) for c in ("kept_id", "kept_hash"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias(own), F.col("x.text_hash").alias(hash_))
    of_text = unused("text_hash", [*docs.columns, own, hash_])
    both = docs.withColumn(of_text, F.xxhash64(text_col))
    semi = both.join(kept, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(of_text) == F.col(hash_)), "left_semi")
    return semi.dropDuplicates([id_col, of_text]).drop(of_text)
