r"""Secret scans in DataFrame expressions: known forms, and a battery of randomness tests over other long runs.

Known forms (kinds `assign`, `access`, `hex`) are the leftmost matches of their patterns. Other runs of 20 or more
characters of a base64-like alphabet are tested, unless they lie within a known form: the encoding is inferred from
the character classes a run uses (hex, or the sum of the classes' sizes), and a battery is taken over its n characters
of an alphabet of k:

- chi-squared distance from the uniform alphabet, against its law for uniform runs and for ordinary writing
  (coincidence index KAPPA);
- the number of runs of one character class against its law for a random order (letters of one case: of vowels);
- the lag-one serial correlation of alphabet places;
- for letters of one case also the share of vowels against that of ordinary writing.

The battery gives two p-values. `structure` is that of a random run (chi-squared too large, runs and serial
correlation to either side: Bonferroni's combination of the three); `ordinary` is that of ordinary writing (chi-squared
as small, and for letters of one case as few vowels: Fisher's combination). A run is reported if ordinary writing is
rejected and randomness is not. Both rejections are Benjamini-Hochberg controls of the false discovery rate within a
class of lengths (doublings of 20; runs of one character class have their own classes), taken over the candidates of
the whole table from a histogram of at most 2 * CLASSES * BINS * BINS counts.

Positions are code points, ends exclusive. Cases: null and empty texts have no span; repeated rows and ids keep their
rows; null ids are kept, and ids may have any type; spans that start together are ordered by kind; an empty table
gives an empty table; very long runs and texts are scanned whole; columns of `docs` stay as they are, whatever their
names, but for `spans` in `with_spans` and the text in `redacted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The known forms, each with the group whose length counts and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RUN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: The coincidence index of ordinary writing, of ordinary runs of few symbols, and the share of vowels in writing.
KAPPA, KAPPA_FEW, VOWELS = 0.066, 0.14, 0.38
#: Length classes, and tenths of the decimal logarithm of a p-value.
CLASSES, BINS = 16, 200
#: The rates of false discoveries: of structure, and the part of `rate` that runs of one character class may have.
STRUCTURE, ONE_CLASS = 0.001, 0.1
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"


def _sequence(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: int, group: int, least: int, block: int = 128) -> Column:
    """Spans of the matches whose group has `least` characters; lengths of gaps and matches are summed block by block."""
    both = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        made = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    def some(acc: Column, x: Column) -> Column:
        inner = F.aggregate(x, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    parts = F.transform(F.array(both), lambda z: F.transform(_sequence(F.ceil(F.size(z) / block).cast("int")), lambda i: F.slice(z, i * block + 1, block)))[0]
    found = F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), some)["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """The normal law's lower tail at -|z|, to a part in a thousand at any distance.

    Up to 3 it is a polynomial's reciprocal power (a classic rational fit of erfc), beyond the asymptotic series.
    """
    x = F.abs(z)
    u = x / math.sqrt(2)
    power = 1 + u * (0.0705230784 + u * (0.0422820123 + u * (0.0092705272 + u * (0.0001520143 + u * (0.0002765672 + u * 0.0000430638)))))
    far = F.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi)) * (1 - 1 / (x * x) + 3 / F.pow(x, F.lit(4.0)) - 15 / F.pow(x, F.lit(6.0)) + 105 / F.pow(x, F.lit(8.0)))
    return F.when(x < 3, 0.5 * F.pow(power, F.lit(-16.0))).otherwise(far)


def lower(z: Column) -> Column:
    """The probability of a normal deviation of z or less."""
    return F.when(z < 0, normal_tail(z)).otherwise(1 - normal_tail(z))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _neighbours(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values)), f)


def even_z(chars: Column, n: Column, k: Column, over: Column) -> Column:
    """struct(even, natural): the chi-squared distance in deviations from its mean for uniform and for ordinary runs."""
    square = let(F.array_sort(chars), lambda s: F.aggregate(
        s, F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["n"] + 1).otherwise(1.0).alias("n"), (a["sum"] + F.when(a["c"] == c, 2 * a["n"] + 1).otherwise(1.0)).alias("sum")),
    )["sum"])
    return let(k / n * square - n - (k - 1), lambda d: F.struct((d / F.sqrt(2 * (k - 1))).alias("even"), ((d - n * over) / F.sqrt(2 * (k - 1) + 4 * n * over)).alias("natural")))


def runs_z(kinds: Column, n: Column) -> Column:
    """Runs of one class among two, in deviations from the mean of a random order."""
    turns = 1 + _sum(_neighbours(kinds, lambda a, b: (a != b).cast("double")))
    return let(_sum(kinds), lambda m: let(1 + 2 * m * (n - m) / n, lambda mean: F.when((m == 0) | (m == n), 0.0).otherwise((turns - mean) / F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1))))))


def serial_z(places: Column, n: Column) -> Column:
    """Lag-one serial correlation times the root of n; a constant run has a large one."""
    return let(_sum(places) / n, lambda mean: let(_sum(F.transform(places, lambda x: (x - mean) * (x - mean))), lambda square: F.when(square <= 0, 99.0).otherwise(
        _sum(_neighbours(places, lambda a, b: (a - mean) * (b - mean))) / square * F.sqrt(n))))


def randomness(value: Column) -> Column:
    """struct(n, one, structure, ordinary): the length, whether one character class is used, and the battery's p-values."""

    def of(plain: Column, chars: Column, hexed: Column) -> Column:
        n = F.size(chars).cast("double")
        size = lambda klass, k: F.when(plain.rlike(klass), float(k)).otherwise(0.0)
        k = F.when(hexed, 16.0).otherwise(size("[a-z]", 26) + size("[A-Z]", 26) + size("[0-9]", 10) + size("[+/_-]", 2))
        letters, digits = plain.rlike("^([a-z]+|[A-Z]+)$"), plain.rlike("^[0-9]+$")
        kind = F.when(digits, "56789").when(hexed, "0123456789").when(letters, "aeiouAEIOU").otherwise("abcdefghijklmnopqrstuvwxyz")
        one = let(kind, lambda c: F.transform(chars, lambda x: (F.instr(c, x) > 0).cast("double")))
        places = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c).cast("double"))
        kappa = F.when(hexed | digits, KAPPA_FEW).otherwise(KAPPA)
        even = let(F.when(digits, 10.0).otherwise(k), lambda k: even_z(chars, n, k, k * kappa - 1))

        def judged(e: Column, runs: Column, serial: Column, share: Column) -> Column:
            structure = F.least(F.lit(1.0), 3 * F.least(lower(-e["even"]), 2 * normal_tail(runs), 2 * normal_tail(serial)))
            ordinary = F.when(letters, let(lower(e["natural"]) * lower((share - VOWELS) * F.sqrt(n / (VOWELS * (1 - VOWELS)))), lambda p: p * (1 - F.log(F.greatest(p, F.lit(1e-300)))))).otherwise(lower(e["natural"]))
            return F.struct(n.alias("n"), (letters | digits).alias("one"), F.greatest(structure, F.lit(1e-19)).alias("structure"), F.greatest(ordinary, F.lit(1e-19)).alias("ordinary"))

        return let(even, lambda e: let(one, lambda x: let(runs_z(x, n), lambda r: let(places, lambda at: let(serial_z(at, n), lambda c: judged(e, r, c, _sum(x) / n))))))

    return let(F.rtrim(value, F.lit("=")), lambda plain: let(F.filter(F.split(plain, ""), lambda c: c != ""), lambda chars: let(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$") & ~plain.rlike("^[0-9]+$"), lambda hexed: of(plain, chars, hexed))))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-10 * F.log10(p))).cast("int")


def scan(text: Column) -> Column:
    """struct(base, runs): known spans, and tested runs that lie within none, with class and bins."""
    base = F.array_sort(F.concat(*(matches(text, p, i, g, n) for i, (p, g, n) in enumerate(KINDS.values()))))

    def both(base: Column) -> Column:
        free = F.filter(matches(text, RUN, len(KINDS), 0, 20), lambda r: ~F.exists(base, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
        tested = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), randomness(r["value"]).alias("t")))
        runs = F.transform(tested, lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"),
            (F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(r["t"]["n"], F.lit(20.0)) / 20))).cast("int") + F.when(r["t"]["one"], CLASSES).otherwise(0)).alias("class"),
            _bin(r["t"]["structure"]).alias("structure"), _bin(r["t"]["ordinary"]).alias("ordinary"),
        ))
        return F.struct(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"))).alias("base"), runs.alias("runs"))

    return let(base, both)


def least_bin(counts: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg over binned p-values: the least bin of which all from there on are rejected, or BINS."""
    m = sum(counts.values())
    passed = [b for b in range(BINS) if (hits := sum(n for at, n in counts.items() if at >= b)) and m * 10 ** (-b / 10) <= rate * hits]
    return min(passed, default=BINS)


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> dict[int, tuple[int, int]]:
    """For each class the least bins of structure and of ordinary writing that are rejected, over all runs of the table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(text.alias("t")).where(F.col("t").rlike(RUN)).select(F.explode(scan(F.col("t"))["runs"]).alias("r"))
    seen = some.groupBy("r.class", "r.structure", "r.ordinary").agg(F.count("*").alias("m")).collect()
    out = {}
    for c in {r["class"] for r in seen}:
        table = [(r["structure"], r["ordinary"], r["m"]) for r in seen if r["class"] == c]
        by_structure, by_ordinary = {}, {}
        for s, _, m in table:
            by_structure[s] = by_structure.get(s, 0) + m
        cut = least_bin(by_structure, STRUCTURE)
        for s, o, m in table:
            if s < cut:  # the others are rejected as structured
                by_ordinary[o] = by_ordinary.get(o, 0) + m
        out[c] = cut, least_bin(by_ordinary, rate * (ONE_CLASS if c >= CLASSES else 1))
    return out


def _spans(text: Column, found: dict[int, tuple[int, int]]) -> Column:
    """Every known and every random span of `text` as (start, end, kind), by start, then kind."""
    limit = lambda i: F.create_map(*(F.lit(x) for c in range(2 * CLASSES) for x in (c, found.get(c, (BINS, BINS))[i])))
    cut, least = limit(0), limit(1)
    plain = lambda x, kind: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"))

    def ordered(x: Column) -> Column:
        hits = F.filter(x["runs"], lambda r: (r["structure"] < cut[r["class"]]) & (r["ordinary"] >= least[r["class"]]))
        both = F.concat(x["base"], F.transform(hits, lambda r: plain(r, F.lit(len(KINDS)))))
        # by start, then kind: ends do not decide
        return F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: plain(x, x["kind"]))

    return let(scan(text), ordered)


def with_spans(docs: DataFrame, text_col: str = "text", rate: float = 0.01, out: str = "spans") -> DataFrame:
    """`docs` with `out`: every known and every random span as (start, end, kind), by start, then kind."""
    return docs.withColumn(out, _spans(F.coalesce(F.col(text_col), F.lit("")), thresholds(docs, text_col, rate)))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "random"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per document: counts by kind, a digest of the known spans, and all spans."""
    df = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rate)
    n = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(KINDS))
    return df.select("doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n(len(KINDS)).alias("n_random"))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """`text` with each outermost span replaced; spans that overlap are replaced as one."""

    def replaced(outer: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(outer, i - 1)["end"]).otherwise(0)
        pieces = F.transform(outer, lambda x, i: F.when(x["start"] < before(i), "").otherwise(F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), F.lit(mark))))
        rest = text.substr(F.element_at(outer, -1)["end"] + 1, F.length(text))
        return F.when(F.size(outer) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)

    def outermost(spans: Column) -> Column:
        ends = F.array_distinct(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.array_sort(F.filter(ends, lambda x: ~F.exists(ends, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]))))

    return let(let(spans, outermost), replaced)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """`docs` with every span of every text replaced by `mark`; all rows and columns stay."""
    own = unused("secret_spans", docs.columns)
    df = with_spans(docs, text_col, rate, own)
    return df.withColumn(text_col, _masked(F.col(text_col), F.col(own), mark)).drop(own)
