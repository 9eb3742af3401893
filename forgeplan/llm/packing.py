"""Variable-capacity best-fit packing of texts into training sequences.

Several sequence lengths are permitted, each at a cost (`cost`: linear in its length, plus a quadratic part for
attention, plus a fixed part a sequence). Short sequences waste the fixed part and long ones the attention, so the
cost a place is least at a length in between (2048 of SIZES). Pieces are placed longest first, each into the open bin
with the least room that holds it; where none does, the least-cost bin size a place among the openable ones that hold
the piece is opened. An early choice of size binds later pieces, so the sizes are chosen jointly: every subset of them
is tried as the openable ones, each bin is finally downsized to the smallest permitted length that holds its
contents, and the outcome of least cost is kept.

Texts longer than the largest length are cut into pieces of that length and a rest; the full pieces fill bins of
their own. Each task packs its own rows, `group_size` rests at a time: nothing is shuffled, so no key or repeated row
can gather in one task, a group is bounded work, and at some thousand rests the seams cost less than a bin a group.
Bins are named by task, group and number, so their names are unique whatever the ids are.

Lengths are words, or any integer column. Ids of any type are carried as they are. Cases: null, empty and blank texts
have no piece; repeated rows are packed as often as they occur, each piece once; rows with a null id are packed too;
equal lengths are placed in the order of the rows; an empty table gives an empty table; very long texts give as many
full pieces as they hold, a batch of rows at a time; other columns are ignored unless kept by name, and `keep` may
not name one of the result's own columns (ValueError).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACE

SIZES = (1024, 2048, 4096)


def cost(size: int, fixed: float = 256.0, window: float = 16384.0) -> float:
    """What a training step pays for a sequence of `size` places."""
    return fixed + size + size * size / window


def best_fit(lengths: Sequence[int], sizes: Sequence[int], openable: Sequence[int]) -> tuple[list[int], list[int]]:
    """The bin of each length (given longest first) and the size each bin was opened with."""
    order = sorted(openable, key=lambda c: (cost(c) / c, c))
    rooms: list[tuple[int, int]] = []  # (room, bin), kept sorted
    bins, opened = [], []
    for n in lengths:
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(opened)
            room = next((c for c in order if c >= n), None) or min(c for c in sizes if c >= n)
            opened.append(room)
        bins.append(b)
        if room > n:
            insort(rooms, (room - n, b))
    return bins, opened


def downsized(lengths: Sequence[int], bins: Sequence[int], sizes: Sequence[int]) -> list[int]:
    """The smallest permitted size for the contents of each bin."""
    used = np.bincount(np.asarray(bins, np.int64), np.asarray(lengths, np.float64)).astype(np.int64)
    return np.asarray(sizes)[np.searchsorted(sizes, used)].tolist()


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int]]:
    """The bin of each length (given longest first) and the final size of each bin, at the least cost of all subsets of sizes."""
    if not len(lengths):
        return [], []
    sizes, best = sorted(sizes), None
    for k in range(1, len(sizes) + 1):
        for openable in combinations(sizes, k):
            bins, _ = best_fit(lengths, sizes, openable)
            final = downsized(lengths, bins, sizes)
            total = sum(map(cost, final))
            if best is None or total < best[0]:
                best = total, bins, final
    return best[1], best[2]


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != ""))


def packed(docs: DataFrame, sizes: Sequence[int] = SIZES, id_col: str = "doc_id", length: Column | None = None, group_size: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, bin_id, bin_size, *keep); bins never cross groups."""
    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_size"]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    sizes = sorted(sizes)
    top = sizes[-1]
    n = (n_words(F.col("text")) if length is None else length).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), *keep).where("n > 0")
    kinds = [LongType(), LongType(), LongType(), StringType(), LongType()]
    schema = StructType([rows.schema["doc_id"], *(StructField(c, k) for c, k in zip(names[1:], kinds)), *(rows.schema[c] for c in keep)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = TaskContext.get().partitionId(), 0

        def made(part: pa.Table, piece: np.ndarray, size: np.ndarray, bins: list[str], final: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = [pa.array(piece), pa.array(piece * top), pa.array(size), pa.array(bins, pa.string()), pa.array(final)]
            yield from pa.table([part.column(0), *own, *(part.column(2 + k) for k in range(len(keep)))], names=[*names, *keep]).to_batches(1 << 16)

        def rests(part: pa.Table) -> Iterator[pa.RecordBatch]:
            n = part.column(1).to_numpy()
            order = np.argsort(-(n % top), kind="stable")
            part, n = part.take(pa.array(order)), n[order]
            bins, final = pack((n % top).tolist(), sizes)
            yield from made(part, n // top, n % top, [f"{task}-{group}-{b}" for b in bins], np.asarray(final, np.int64)[bins])

        held: list[pa.Table] = []
        n_held, n_full = 0, 0
        for batch in parts:
            part = pa.Table.from_batches([batch])
            n = part.column(1).to_numpy()
            count = n // top
            for at in range(0, len(n), 4096):  # full pieces, each a bin
                some = count[at : at + 4096]
                of = np.repeat(np.arange(at, at + len(some)), some)
                if len(of):
                    piece = np.arange(len(of)) - np.repeat(np.cumsum(some) - some, some)
                    yield from made(part.take(pa.array(of)), piece, np.full(len(of), top), [f"{task}-full-{k}" for k in range(n_full, n_full + len(of))], np.full(len(of), top))
                    n_full += len(of)
            held.append(part.filter(pa.array(n % top > 0)))
            n_held += held[-1].num_rows
            while n_held >= group_size:
                whole = pa.concat_tables(held)
                yield from rests(whole.slice(0, group_size))
                held, n_held, group = [whole.slice(group_size)], n_held - group_size, group + 1
        if n_held:
            yield from rests(pa.concat_tables(held))

    return rows.mapInArrow(run, schema)
