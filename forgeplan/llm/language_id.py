"""Language identification by bit-sliced Bloom filters of letter n-grams.

One filter row holds, for every language, one bit: reading the rows of an n-gram's hashes and and-ing them names at
once all languages whose filter contains the n-gram. A text's n-grams are counted per language, each count is
corrected for the filter's own rate of false positives, and the largest count decides (ties: the first by name).

Each filter holds the n-grams found in most training texts of its language, `grams` at most and in two at least. It
is fitted on about `sample_rows` texts of each language (those with the smallest hash of their id), from rows that
are not held out; every language is learnt, at one bit of each filter row (2 MB for 64 languages). Every row is
predicted.

N-grams are windows of four letters of the lower-cased text, any run of other characters around words being one
blank; at most the first and last place may be blank.

Cases: null texts and texts without a letter are `und` with score 0, as is every text if nothing was learnt; a text
with letters but no known n-gram gets the first language by name with score 0; null languages are not learnt from;
repeated rows and null ids keep their rows; an empty table gives an empty table; very long texts are read in
overlapping steps; columns named like the two results are replaced, others stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, is_held_out, mix

#: Unicode has no letters from here on.
LETTERS_END = 0x32400


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    rows: np.ndarray  # (2 ** bits, ceil(languages / 64)) of uint64
    rates: np.ndarray  # false positives of each language
    hashes: int


def letters() -> np.ndarray:
    return np.fromiter((c < LETTERS_END and chr(c).isalpha() for c in range(LETTERS_END + 1)), bool, LETTERS_END + 1)


def grams(texts: list[str | None], table: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, n-gram hash) of every n-gram and the rows with a letter, some rows or part of a row at a time."""
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), step):  # pieces overlap, so no n-gram is lost or seen twice
            yield from _grams(i, t[max(0, at - 3) : at + step].lower(), table, at > 0, at + step < len(t))


def _grams(i: int, text: str, table: np.ndarray, before: bool, after: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    c = np.frombuffer(f"{'' if before else ' '}{text}{'' if after else ' '}".encode("utf-32-le", "replace"), np.uint32)
    yield _windows(np.full(len(c), i), c, table)


def _windows(rows: np.ndarray, c: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    is_letter = table[np.minimum(c, LETTERS_END)]
    if len(c) < 4:
        return rows[:0], np.zeros(0, np.uint64), np.unique(rows[is_letter])
    c = np.where(is_letter, c, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter[1:-2] & is_letter[2:-1] & (rows[:-3] == rows[3:]))
    h = c[at] | c[at + 1] << np.uint64(21) | c[at + 2] << np.uint64(42)
    return rows[at], mix(h ^ mix(c[at + 3] + np.uint64(7))), np.unique(rows[is_letter])


def batch_grams(texts: pa.Array, table: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As `grams`, short texts together in one array."""
    held, size, first = [], 0, 0
    values = [(t or "") for t in texts.to_pylist()]
    for i, t in enumerate([*values, None]):
        if t is None or size + len(t) > step:
            if held:
                n = np.fromiter((len(x) + 2 for x in held), np.int64, len(held))
                c = np.frombuffer("".join(f" {x} " for x in held).encode("utf-32-le", "replace"), np.uint32)
                yield _windows(np.repeat(np.arange(first, first + len(held)), n), c, table)
            held, size, first = [], 0, i
        if t is None:
            return
        if len(t) > step:
            yield from ((row + i, h, some + i) for row, h, some in grams([t], table, step))
            first = i + 1
        else:
            low = t.lower()
            held.append(low)
            size += len(low)


def fit(docs: DataFrame, sample_rows: int = 400, gram_count: int = 8192, bits: int = 18, hashes: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    counts = own.groupBy("lang").count().collect()  # a row a language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Filters([], np.zeros((1 << bits, 1), np.uint64), np.zeros(0), hashes)
    share = F.from_json(F.lit(json.dumps({r["lang"]: min(1.0, sample_rows / r["count"]) for r in counts})), "map<string,double>")
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for part in parts:
            for a, b in chunks(part, 1):
                names, code = np.unique(np.array(part.column(0).slice(a, b - a).to_pylist(), object), return_inverse=True)
                once = [np.unique(np.stack([row.astype(np.uint64), h]), axis=1) for row, h, _ in batch_grams(part.column(1).slice(a, b - a), table)]
                for k, name in enumerate(names):
                    g, n = np.unique(np.concatenate([o[1][code[o[0].astype(np.int64)] == k] for o in once] or [np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    found = own.where(hashed < share[F.col("lang")]).select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    top = found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= gram_count).select("lang", "gram").toArrow()
    rows = np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64)
    at_name = {x: j for j, x in enumerate(languages)}
    lang = np.array([at_name[x] for x in top["lang"].to_pylist()], np.int64)
    h = top["gram"].to_numpy().view(np.uint64)
    for at in places(h, bits, hashes):
        np.bitwise_or.at(rows, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([np.count_nonzero(rows[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)) for j in range(len(languages))]) / (1 << bits)
    return Filters(languages, rows, fill**hashes, hashes)


def places(h: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The filter rows of each n-gram."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def counts(texts: pa.Array, f: Filters, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the n-grams, those of each language, and whether it has a letter."""
    total, own, some = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(f.languages)), np.int64), np.zeros(len(texts), bool)
    bits = len(f.rows).bit_length() - 1
    for row, h, lettered in batch_grams(texts, table):
        some[lettered] = True
        total += np.bincount(row, minlength=len(texts))
        for w in range(f.rows.shape[1]):
            mask = np.full(len(h), 2**64 - 1, np.uint64)
            for at in places(h, bits, f.hashes):
                mask &= f.rows[at, w]
            for j in range(64 * w, min(64 * w + 64, len(f.languages))):
                own[:, j] += np.bincount(row[(mask >> np.uint64(j % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
    return total, own, some


def predicted(docs: DataFrame, f: Filters, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the predicted language and the corrected share of its n-grams that this language's filter contains."""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    source = docs.select(*kept)
    at = kept.index(text_col)
    others = [c for c in kept if c != text_col]
    schema = StructType([*(source.schema[c] for c in others), StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for part in parts:
            for a, b in chunks(part, at):
                piece = part.slice(a, b - a)
                total, own, some = counts(piece.column(at), f, table)
                if f.languages:
                    n = np.maximum(total, 1)[:, None]
                    true = np.clip((own - n * f.rates) / (1 - f.rates) / n, 0, 1) * (total > 0)[:, None]
                    best = true.argmax(axis=1)
                    names = [f.languages[j] if s else "und" for j, s in zip(best, some)]
                    score = np.where(some, true[np.arange(len(best)), best], 0.0)
                else:
                    names, score = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in others), pa.array(names, pa.string()), pa.array(score)], names=[*others, lang_out, score_out])

    return source.select(*kept).mapInArrow(run, schema)
