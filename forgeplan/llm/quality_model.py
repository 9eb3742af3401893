"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

Words are cut into letter runs (lower case, preceded by a mark if written in capitals), digit runs (one mark) and
single symbols. Unigrams and bigrams of these tokens are hashed to `2 ** bits` weights, all bigrams of a token with
itself to one; a text's features are its counts over the number of its features, so its score is one sparse dot product, whatever its length.

The model is fitted on at most `sample_rows` labelled rows, those with the smallest hash of their id, read only from
rows that are not held out. Every row is scored.

Cases: null, empty and blank texts get the score of the intercept; null labels are not learnt from; ids with
several labels count as their mean, repeated ids as their smallest text; with no label, or one class only, the
intercept alone answers; repeated rows keep their rows; a column named like an added one is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, is_held_out, mix, words

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
SCALE = 20.0


@dataclass(frozen=True)
class Model:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.index] = self.weight
        return w


def _tokens(word: str) -> list[int]:
    out = []
    for t in TOKEN.findall(word):
        if t[0].isdigit():
            t = "0"
        elif len(t) > 1 and t.isupper():
            out.append(1)
        out.append(zlib.crc32(t.lower().encode()))
    return out


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every token and every pair of neighbours."""
    rows, codes, distinct = words(texts)
    each = [_tokens(w) for w in distinct.to_pylist()]
    size = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((x for t in each for x in t), np.uint64, int(size.sum()))
    n = size[codes]
    at = np.repeat((np.cumsum(size) - size)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    token, row = flat[at], np.repeat(rows, n)
    both = row[1:] == row[:-1]
    pair = token[:-1][both] * np.uint64(0x9E3779B97F4A7C15) + token[1:][both] + np.uint64(1 << 40)
    pair[token[:-1][both] == token[1:][both]] = 1 << 41
    keep = np.uint64((1 << bits) - 1)
    return np.concatenate([row, row[1:][both]]), (mix(np.concatenate([token, pair])) & keep).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of at most `sample_rows` labelled rows that are not held out."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    ids = own.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def ftrl(rows: Iterable[tuple[float, np.ndarray, np.ndarray]], bits: int, epochs: int = 4, alpha: float = 0.3, beta: float = 0.1, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Fits (label, features, values) rows in order; feature 2 ** bits is the intercept, which l1 spares."""
    m = (1 << bits) + 1
    z, n = np.zeros(m), np.zeros(m)
    rate = np.full(m, l1)
    rate[-1] = 0.0

    def weights(j: np.ndarray) -> np.ndarray:
        out = -(z[j] - np.sign(z[j]) * rate[j]) / ((beta + np.sqrt(n[j])) / alpha + l2)
        return np.where(np.abs(z[j]) <= rate[j], 0.0, out)

    for _ in range(epochs):
        for y, j, x in rows:
            j, x = np.append(j, m - 1), np.append(x, 1.0)
            w = weights(j)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / alpha * w
            n[j] += g * g
    w = weights(np.arange(m))
    index = np.flatnonzero(w[:-1])
    return Model(bits, index, w[index], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = 4096, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> Model:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in chunks(part, 2):
                row, feature = features(part.column(2).slice(a, b - a), bits)
                key, count = np.unique(row << bits | feature, return_counts=True)
                cut = np.searchsorted(key >> bits, np.arange(b - a + 1))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), lists(key & ((1 << bits) - 1)), lists(count)], names=["doc_id", "y", "j", "c"])

    rows = sample(docs, labels, target, sample_rows, id_col, text_col).select(F.col("doc_id").cast("long"), "y", "text")
    got = rows.mapInArrow(run, "doc_id long, y double, j array<int>, c array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return ftrl([], bits)
    y, cut = got["y"].to_numpy(), got["j"].chunk(0).offsets.to_numpy()
    j, c = (got[x].chunk(0).values.to_numpy() for x in ("j", "c"))
    cut = cut - cut[0]
    order = np.random.default_rng(0).permutation(got.num_rows).tolist()
    model = ftrl(_Rows(order, y, cut, j, c), bits)
    del got, y, j, c
    pa.default_memory_pool().release_unused()
    return model


@dataclass(frozen=True)
class _Rows:
    """The training rows in order, cut from flat arrays when they are read."""

    order: list[int]
    y: np.ndarray
    cut: np.ndarray
    j: np.ndarray
    c: np.ndarray

    def __iter__(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for k in self.order:
            part = slice(self.cut[k], self.cut[k + 1])
            yield self.y[k], self.j[part].astype(np.int64), SCALE * self.c[part] / max(1, self.c[part].sum())


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the model's probability of label 1."""
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*kept)
    schema = StructType([*source.schema.fields, StructField(out, DoubleType())])
    at = kept.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense()
        for part in parts:
            for a, b in chunks(part, at):
                row, feature = features(part.column(at).slice(a, b - a), model.bits)
                n = np.bincount(row, minlength=b - a)
                x = np.bincount(row, w[feature], minlength=b - a) * SCALE / np.maximum(n, 1) + model.intercept
                yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns, pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=[*kept, out])

    return source.mapInArrow(run, schema)
