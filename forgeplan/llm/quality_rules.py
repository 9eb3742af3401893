r"""Quality rules by tokeniser fertility.

Public vocabularies are applied to every word of every text: one with byte fallback to words in the scripts that it
was made for (PROSE), a multilingual one of bytes to the others. Their fit is measured by characters per token, the
share of tokens that are bytes without a piece (for the vocabulary of bytes: tokens that are no whole characters), and
the entropy of the text's tokens over the entropy that as many different tokens would have. Fixed outer bands for
these hold by the script that most words are written in, whatever the script. Within them each language (a null one:
each script) has bands of its own for all three: `limit` robust deviations about its median, to either side for
characters per token, upwards for the byte share and downwards for the entropy. The deviation of a share shrinks as the
root of a text's words, so the difference from the median times that root is compared with its scale, 1.4826 times the
median absolute one (FLOORS at least). Entropy falls with a text's length, so it has a median and a scale for each
doubling of words instead. Medians are exact over histograms of all documents; bands with under `least_texts` texts
reject nothing. Texts that the vocabularies of running prose do not fit are rejected:
noise, symbols between words, capitals throughout, encodings. Words are `[^\x20\x09-\x0D]+`; rules on words and
repeated windows come first and reject by themselves.

The vocabulary files are read on the driver and shipped; each distinct word of a batch is tokenised once. Bands are a
few numbers a language, so they reach the driver and go out as a literal; no row is shuffled but counts of steps.

Ids of any type are carried as they are. Cases: null, empty and blank texts have no word and fail the base rules;
texts in scripts without an outer band of their own get the widest one; repeated rows and null ids keep their rows; an
empty table gives an empty table; very long texts are measured whole; other columns, also such as are named like the
result's, are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, staged, words

#: The vocabulary with byte fallback, and the multilingual one of bytes.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The scripts that the former was made for.
PROSE = ("latin", "cyrillic", "greek", "other")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: The first code point of blocks, and the script of each block.
BLOCKS = [(0, "other"), (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32400, "other")]


@dataclass(frozen=True)
class Band:
    """Accepted values; texts of under `least_tokens` tokens are not held to the entropy."""

    chars: tuple[float, float]
    byte_share: float
    entropy: float
    least_tokens: int = 64


WIDEST = Band((0.2, 8.0), 0.8, 0.25)
#: Measures with bands of their own: the step of their medians, the least scale, and the sides that are rejected.
STEPS = {"chars_per_token": 0.001, "byte_share": 0.001, "entropy": 0.001}
FLOORS = {"chars_per_token": 0.3, "byte_share": 0.2, "entropy": 0.02}
SIDES = {"chars_per_token": (True, True), "byte_share": (False, True), "entropy": (True, False)}  # (low, high)


@dataclass(frozen=True)
class Bands:
    by_script: dict[str, Band] = field(default_factory=lambda: {
        "latin": Band((1.2, 6.0), 0.05, 0.35),
        "cyrillic": Band((1.0, 6.0), 0.1, 0.35),
        "greek": Band((0.6, 4.0), 0.2, 0.35),
        "other": Band((0.2, 8.0), 1.0, 0.25),  # scripts that neither vocabulary knows are spelt in bytes
    })

    def of(self, script: str) -> Band:
        return self.by_script.get(script, WIDEST)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64())]


def _repeats(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """For each text the words in windows that it has twice or more."""
    m = len(codes) - WINDOW + 1
    if m < 2:
        return np.zeros(n, np.int64)
    h = mix(rows[:m].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        h = mix(h ^ codes[k : m + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.subtract.at(step, np.flatnonzero(twice) + WINDOW, 1)
    return np.bincount(rows[np.cumsum(step)[:-1] > 0], minlength=n)


def _dup_lines(texts: pa.Array, n: int) -> np.ndarray:
    parts = pc.split_pattern(texts, "\n")
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    codes = pc.filter(flat, full).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = rows[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    first = np.unique(rows << 32 | codes) >> 32
    return np.bincount(rows, minlength=n) - np.bincount(first, minlength=n)


def _script(word: str) -> int:
    c = next((ord(x) for x in word if x.isalpha()), 0)
    return int(np.searchsorted(_EDGES, c, "right")) - 1


_EDGES = [b[0] for b in BLOCKS]
_NAMES = sorted({b[1] for b in BLOCKS})


class Vocabularies:
    """Tokens of words, numbered apart for the two vocabularies, and which of them are bytes without a piece."""

    def __init__(self, proto: bytes, ranks: bytes | None):
        import sentencepiece

        self.prose = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.is_byte = np.array([self.prose.is_byte(i) for i in range(self.prose.get_piece_size())], float)
        self.first, self.other = len(self.is_byte), None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.other = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
            whole = np.ones(max(table.values()) + 1)
            for piece, k in table.items():
                try:
                    piece.decode()
                    whole[k] = 0.0
                except UnicodeDecodeError:
                    pass
            self.is_byte = np.concatenate([self.is_byte, whole])

    def tokens(self, words: list[str], prose: np.ndarray) -> list[list[int]]:
        if self.other is None:
            return self.prose.encode(words, num_threads=1)
        out: list = [None] * len(words)
        for k, t in zip(np.flatnonzero(prose).tolist(), self.prose.encode([words[k] for k in np.flatnonzero(prose)], num_threads=1)):
            out[k] = t
        for k in np.flatnonzero(~prose).tolist():
            out[k] = [self.first + t for t in self.other.encode_ordinary(words[k])]
        return out


def measured(texts: pa.Array, vocabularies: Vocabularies, bands: Bands) -> list:
    """The columns of FIELDS for each text."""
    is_byte = vocabularies.is_byte
    n = len(texts)
    texts = pc.fill_null(texts, "")
    rows, codes, distinct = words(texts)
    rows = rows.astype(np.int64)
    n_words = np.bincount(rows, minlength=n)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = np.bincount(rows, length[codes], minlength=n).astype(np.int64)
    symbols = np.fromiter((len(b) - len(b.translate(None, SYMBOLS)) for b in (t.as_py() for t in texts.cast(pa.binary()))), np.int64, n)
    repeat = _repeats(rows, codes, n)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    spelled = distinct.to_pylist()
    block = np.array([_NAMES.index(BLOCKS[_script(w)][1]) for w in spelled], np.int64)
    pieces = vocabularies.tokens(spelled, np.isin(block, [_NAMES.index(x) for x in PROSE]))
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((x for p in pieces for x in p), np.int64, int(size.sum()))
    count = size[codes]
    token = flat[np.repeat((np.cumsum(size) - size)[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    of = np.repeat(rows, count)
    total = np.bincount(of, minlength=n)
    key, times = np.unique(of << 20 | token, return_counts=True)
    share = times / np.maximum(total, 1)[key >> 20]
    entropy = np.bincount(key >> 20, -share * np.log2(share), minlength=n) / np.log2(np.maximum(np.minimum(total, vocabularies.first), 2))
    chars = word_chars / np.maximum(total, 1)
    byte_share = np.bincount(of, is_byte[token], minlength=n) / np.maximum(total, 1)
    votes = np.zeros((n, len(_NAMES)), np.int64)
    np.add.at(votes, (rows, block[codes]), 1)
    votes[:, _NAMES.index("other")] = np.minimum(votes[:, _NAMES.index("other")], 0) + (votes.sum(axis=1) == votes[:, _NAMES.index("other")])
    script = [_NAMES[k] for k in votes.argmax(axis=1)]
    b = [bands.of(s) for s in script]
    low, high, most, least, tokens = (np.array(x, float) for x in ([x.chars[0] for x in b], [x.chars[1] for x in b], [x.byte_share for x in b], [x.entropy for x in b], [x.least_tokens for x in b]))
    kept = ~failed & (chars >= low) & (chars <= high) & (byte_share <= most) & ((entropy >= least) | (total < tokens))
    return [n_words, word_chars, symbols, _dup_lines(texts, n), repeat, failed, kept, script, chars, byte_share, entropy]


def measures(docs: DataFrame, vocabulary: str = VOCABULARY, multilingual: str | None = MULTILINGUAL, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """(doc_id, lang, *FIELDS) for every row of `docs`, under the fixed bands alone."""
    proto, ranks, bands = Path(vocabulary).read_bytes(), multilingual and Path(multilingual).read_bytes(), bands or Bands()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    sql = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    schema = ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string", *(f"{n} {sql[t]}" for n, t in FIELDS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies(proto, ranks)
        for part in parts:
            for a, b in chunks(part, 2):
                cols = measured(part.column(2).slice(a, b - a), vocabularies, bands)
                yield pa.RecordBatch.from_arrays([*(part.column(i).slice(a, b - a) for i in (0, 1)), *(pa.array(c, t) for c, (_, t) in zip(cols, FIELDS))], names=["doc_id", "lang", *(n for n, _ in FIELDS)])

    return source.mapInArrow(run, schema)


def medians(counts: list, names: list[str]) -> dict[str, dict[str, tuple[int, float]]]:
    """For each measure and band the number of texts and the lower median, from (measure, band, step, texts) rows."""
    out: dict = {name: {} for name in names}
    by: dict = {}
    for r in counts:
        by.setdefault((r["name"], r["band"]), []).append((r["bin"], r["m"]))
    for (name, band), steps in by.items():
        n, up_to = sum(m for _, m in steps), 0
        for at, m in sorted(steps):
            up_to += m
            if 2 * up_to >= n:
                out[name][band] = n, at
                break
    return out


def _band(measure: str) -> Column:
    """The band of a row: its language or script, with the doubling of words for the entropy."""
    return F.concat_ws(" ", "band", F.floor(F.log2("n_words")).cast("string")) if measure == "entropy" else F.col("band")


def _away(measure: str, middle: Column) -> Column:
    return (F.col(measure) - middle) * (F.lit(1.0) if measure == "entropy" else F.sqrt("n_words"))


def _histogram(rows: DataFrame, values: dict[str, Column], steps: dict[str, float]) -> list:
    """(name, band, bin, m): how many texts of a band have each step of each value; the steps are bounded, whatever the texts."""
    each = F.array(*(F.struct(F.lit(k).alias("name"), _band(k).alias("band"), F.round(F.least(v, F.lit(steps[k] * 20_000)) / steps[k]).cast("long").alias("bin")) for k, v in values.items()))
    return rows.select(F.explode(each).alias("x")).groupBy("x.name", "x.band", "x.bin").agg(F.count("*").alias("m")).collect()


def own_bands(rows: DataFrame, least_texts: int) -> dict[str, dict[str, tuple[float, float]]]:
    """For each measure and band the median and the scale of deviations from it, over all `rows` that pass the base rules."""
    fit = rows.where(~F.col("base_failed"))
    middle = medians(_histogram(fit, {k: F.col(k) for k in STEPS}, STEPS), list(STEPS))
    middles = {k: {band: at * STEPS[k] for band, (_, at) in middle[k].items()} for k in STEPS}
    wide = {k: s if k == "entropy" else 10 * s for k, s in STEPS.items()}
    spread = medians(_histogram(fit, {k: F.abs(_away(k, _of(middles[k], k))) for k in STEPS}, wide), list(STEPS))
    return {k: {band: (middles[k][band], max(1.4826 * spread[k][band][1] * wide[k], FLOORS[k])) for band, (n, _) in middle[k].items() if n >= least_texts} for k in STEPS}


def _of(values: dict[str, float], measure: str) -> Column:
    """The value of a row's band, null where it has none; bands are languages and scripts, so they are few."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,double>")[_band(measure)]


def report(docs: DataFrame, vocabulary: str = VOCABULARY, multilingual: str | None = MULTILINGUAL, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", limit: float = 5.5, least_texts: int = 50) -> DataFrame:
    """(doc_id, *FIELDS) for every row of `docs`."""
    rows = staged(measures(docs, vocabulary, multilingual, bands, id_col, text_col, lang_col).withColumn("band", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"))), "measures")
    own, held = own_bands(rows, least_texts), F.lit(True)
    for k, (low, high) in SIDES.items():
        middle, scale = (_of({band: v[i] for band, v in own[k].items()}, k) for i in (0, 1))
        away = _away(k, middle) / scale
        passed = (away >= -limit if low else F.lit(True)) & (away <= limit if high else F.lit(True))
        held = held & F.coalesce(passed, F.lit(True))
    return rows.withColumn("kept", F.col("kept") & held).select("doc_id", *(n for n, _ in FIELDS))
