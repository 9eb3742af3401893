r"""Benchmark decontamination by template canonicalisation, in DataFrame expressions.

Texts become tokens (white space cut, punctuation trimmed). A token becomes a typed placeholder if it is a number, a
unit after a number, or a name (capitalised inside a sentence); other tokens are lower-cased words. Windows of WINDOW
template tokens are hashed and joined with the windows of all benchmark items. (Items of which `share` may leave no
whole window have shorter ones.) Windows with more placeholders than words would match any row of numbers or names;
they are hashed by their own words instead, as are items of less than 4 tokens.

A hit proposes an alignment of the item with the text. Of n tokens of which e may differ, at least n - WINDOW + 1 -
e * WINDOW windows must be hit on the alignment, or on two that lie within SHIFT tokens (words were put in or left
out, which costs WINDOW - 1 windows more): others are dropped before any text is looked at. The remaining texts are
read again, and the alignments checked in full: the share of the item's tokens whose templates agree there, and
whether the slots are filled consistently - every value of the item stands for one value of the text. An item with
its numbers, names or units changed throughout is thus found, a text that merely looks like its template is not.

A document holds an item if one alignment agrees on `share` of the item's tokens, or the first part of one and the
second part of another within SHIFT tokens. Places of alignments elsewhere in a text never add up.

A Bloom filter of the benchmark's windows (PROBES of 16 bits a window, at most 2 MB) is probed inside each row, so only
windows that are almost surely in the benchmark leave it. They meet the benchmark's windows in an exact hash join, which
broadcasts these while they number `broadcast_windows` at most and shuffles both sides above. Texts with an alignment
are found again by a Bloom filter of their hashes.

Ids of any type are carried as they are. Cases: null or blank texts and items hold nothing; items of less than 4 tokens
must be found word for word (letters in either case); repeated documents and items are reported once for each
(doc_id, item_id); of equally good alignments the first is reported; null ids are kept and compare equal; empty tables
give an empty table; very long texts are searched whole; columns that `decontaminated` is given stay, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged, unused
from .secrets import let

WINDOW, SHIFT = 3, 8
#: Items of fewer tokens are compared word for word.
LEAST = 4
#: Bits of the Bloom filter that each window sets.
PROBES = 4
#: Characters trimmed from tokens, and units.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’¡¿…–—"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons tonnes pound pounds lb lbs oz "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent cent cents dollar dollars euro euros degree degrees watt watts kw mph"
).split()


def tokens(text: Column) -> Column:
    """Trimmed tokens; sentence starts and words in capitals are lowered, so a capital left marks a name."""
    cut = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")

    def one(words: Column) -> Column:
        def token(w: Column, i: Column) -> Column:
            start = (i == 0) | F.right(F.get(words, i - 1), F.lit(1)).isin(".", "!", "?", ":", "")
            return let(F.btrim(w, F.lit(PUNCTUATION)), lambda t: F.when(start | (F.upper(t) == t), F.lower(t)).otherwise(t))

        return F.filter(F.transform(words, token), lambda t: t != "")

    return let(cut, one)


def _mark(kind: str) -> Column:
    """Placeholders have odd hashes, words even ones."""
    return F.xxhash64(F.lit(f"<{kind}>")).bitwiseOR(F.lit(1))


def template(tokens: Column) -> Column:
    """The hash of each token, of its placeholder for numbers, units and names."""
    digit = lambda t: F.left(t, F.lit(1)).between("0", "9")
    kind = lambda all_, t, i: F.when(digit(t), _mark("number")).when(F.left(t, F.lit(1)) != F.lower(F.left(t, F.lit(1))), _mark("name")).when(t.isin(UNITS) & (i > 0) & digit(F.get(all_, i - 1)), _mark("unit")).otherwise(F.xxhash64(t).bitwiseAND(F.lit(-2)))
    return let(tokens, lambda all_: F.transform(all_, lambda t, i: kind(all_, t, i)))


def windows(template: Column, width: int) -> Column:
    """The hash of every window of `width` template tokens."""
    heads = F.slice(template, F.lit(1), F.greatest(F.size(template) - (width - 1), F.lit(0)))
    return F.transform(heads, lambda t, i: F.xxhash64(t, *(F.get(template, i + k) for k in range(1, width))))


def _by_words(raw: Column, width: int) -> Callable[[Column], Column]:
    """The hash of the words of the window at a place."""
    return lambda i: F.xxhash64(F.lit(width), *(F.lower(F.get(raw, i + k)) for k in range(width)))


def _sound(template: Column, width: int) -> Callable[[Column], Column]:
    """Whether words outnumber the placeholders of the window at a place, or are as many."""
    return lambda i: 2 * reduce(lambda x, y: x + y, (F.get(template, i + k).bitwiseAND(F.lit(1)) for k in range(width))) <= width


def _probe(hash_: Column, k: int) -> Column:
    """The bits of probe k: two from the hash itself, more by hashing it."""
    return hash_ if k == 0 else F.shiftrightunsigned(hash_, 32) if k == 1 else F.xxhash64(hash_, F.lit(k))


def bloom(hashes: DataFrame, slots: int) -> Column:
    """The Bloom filter of column `window` as a literal of `slots` longs, a power of two; no more than these reach the driver."""
    bits = hashes.select(F.explode(F.array(*(_probe(F.col("window"), k) for k in range(PROBES)))).alias("h"))
    own = bits.groupBy(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    dense = [0] * slots
    for r in own.collect():
        dense[r["slot"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, dense))), ",").cast("array<bigint>")


def slots_for(n: int) -> int:
    """Longs of a filter of n hashes: 16 bits each, 8 KB at least and 2 MB at most."""
    return 1 << max(10, min(18, math.ceil(math.log2(max(1, n) / 4))))


def contains(filter_: Column, slots: int, window: Column) -> Column:
    def test(h: Column) -> Column:
        return F.getbit(F.get(filter_, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(slots - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return reduce(lambda x, y: x & y, (test(_probe(window, k)) if k == 0 else let(_probe(window, k), test) for k in range(PROBES)))


def _items(benchmark: DataFrame, item_col: str, text_col: str, share: float) -> DataFrame:
    """(item_id, item_raw, item_template, item_key, n, width, least): `least` windows must be hit."""
    df = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    df = df.withColumn("item_raw", tokens(F.col("t"))).withColumn("item_template", template(F.col("item_raw"))).withColumn("n", F.size("item_raw"))
    agree = F.ceil(share * F.col("n") - F.lit(1e-9))
    off = F.col("n") - agree
    width = F.when(F.col("n") < LEAST, F.col("n")).otherwise(F.least(F.lit(WINDOW), F.ceil(agree / (off + 1)))).cast("int")
    least = F.greatest(F.lit(1), F.col("n") - (F.col("width") - 1) - off * F.col("width") - (F.col("width") - 1)).cast("long")
    return df.where("n > 0").withColumn("width", width).withColumn("least", least).withColumn("item_key", F.xxhash64("item_id", "t")).drop("t")


def _alignments(docs: DataFrame, items: DataFrame, broadcast_windows: int) -> DataFrame:
    """(text_hash, item_key, start) of the alignments with enough windows; `docs`: (text_hash, text).

    The filter has the template hash of every window of the benchmark, and the hash of its words where that is the key.
    """
    kinds = sorted((r["width"], r["literal"]) for r in items.select("width", (F.col("n") < LEAST).alias("literal")).distinct().collect())  # WINDOW + LEAST at most
    made, by_template = {}, {}
    for width, literal in kinds:
        own = items.where((F.col("width") == width) & ((F.col("n") < LEAST) == F.lit(literal))).select("item_key", "least", "item_raw", "item_template", F.posexplode(windows(F.col("item_template"), width)).alias("item_at", "plain"))
        key = _by_words(F.col("item_raw"), width)(F.col("item_at"))
        made[width, literal] = own.select("item_key", "least", "item_at", (key if literal else F.when(_sound(F.col("item_template"), width)(F.col("item_at")), F.col("plain")).otherwise(key)).alias("window"))
        by_template[width, literal] = own.select(F.col("plain").alias("window"))
    if not made:
        return docs.select("text_hash", F.lit(0).cast("long").alias("item_key"), F.lit(0).alias("start")).limit(0)
    sizes = {k: df.count() for k, df in made.items()}
    hint = F.broadcast if sum(sizes.values()) <= broadcast_windows else (lambda df: df)
    found = []  # all kinds of windows in one pass over the tokens
    for width, literal in made:
        slots = slots_for(2 * sizes[width, literal])
        words, sound = _by_words(F.col("raw"), width), _sound(F.col("template"), width)

        def seen(f: Column, h: Column, i: Column) -> Column:
            by_words = let(words(i), lambda k: F.when(contains(f, slots, k), F.struct(i.alias("at"), k.alias("window"))))  # noqa: B023
            return F.when(contains(f, slots, h), by_words if literal else F.when(sound(i), F.struct(i.alias("at"), h.alias("window"))).otherwise(by_words))  # noqa: B023

        filter_ = bloom(made[width, literal].select("window").unionByName(by_template[width, literal]), slots)
        found.append(let(filter_, lambda f: F.filter(F.transform(windows(F.col("template"), width), lambda h, i: seen(f, h, i)), lambda x: x.isNotNull())))  # noqa: B023
    base = docs.withColumn("raw", tokens(F.col("text"))).withColumn("template", template(F.col("raw"))).withColumn("some", F.concat(*found))
    # outer: the filter that Spark infers from an inner explode would compute the windows twice
    own = base.select("text_hash", F.explode_outer("some").alias("x")).where("x is not null").select("text_hash", "x.at", "x.window")
    hits = own.join(hint(reduce(DataFrame.unionByName, made.values())), "window").withColumn("start", F.col("at") - F.col("item_at"))
    # one row for an item's window at a place: repeated documents and windows count once
    hits = hits.groupBy("text_hash", "item_key", "start").agg(F.countDistinct("item_at").alias("hits"), F.first("least").alias("least"))
    by = Window.partitionBy("text_hash", "item_key").orderBy("start")
    other = F.greatest(F.max("hits").over(by.rangeBetween(-SHIFT, -1)), F.max("hits").over(by.rangeBetween(1, SHIFT)), F.lit(0))
    return hits.withColumn("other", other).where("hits + other >= least").select("text_hash", "item_key", "start")


def _agreement(hits: DataFrame) -> DataFrame:
    """Adds `same` (places of the item that agree), `literal` (those with the same word) and `consistent` (each slot value has one)."""
    first = F.greatest(F.col("start"), F.lit(0))
    cut = lambda c: F.slice(c, first + 1, F.greatest(F.col("n") - (first - F.col("start")), F.lit(0)))
    hits = hits.withColumn("raw", cut("raw")).withColumn("template", cut("template"))
    skip = F.greatest(-F.col("start"), F.lit(0))
    pair = F.transform("template", lambda t, i: F.struct((i + skip).alias("at"), t.alias("t"), F.lower(F.get("raw", i)).alias("doc"), F.lower(F.get("item_raw", i + skip)).alias("item"), F.get("item_template", i + skip).alias("it")))
    hits = hits.withColumn("pair", F.filter(pair, lambda p: (p["t"] == p["it"]) | (p["doc"] == p["item"])))
    marked = F.filter("pair", lambda p: p["t"].bitwiseAND(F.lit(1)) == 1)
    slots = F.array_distinct(F.transform(marked, lambda p: F.struct(p["t"].alias("t"), p["item"].alias("item"), p["doc"].alias("doc"))))
    hits = hits.withColumn("same", F.transform("pair", lambda p: p["at"])).withColumn("literal", F.transform(F.filter("pair", lambda p: p["doc"] == p["item"]), lambda p: p["at"]))
    return hits.withColumn("consistent", let(slots, lambda s: F.size(s) == F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["t"], x["item"]))))))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = 1_000_000) -> DataFrame:
    """(text_hash, item_id, covered, start, exact) for every text and item that it holds."""
    items = _items(benchmark, item_col, item_text_col, share)
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = staged(_alignments(texts, items, broadcast_windows), "alignments")
    known = found.select(F.col("text_hash").alias("window")).distinct()
    slots = slots_for(known.count())
    again = texts.where(let(bloom(known, slots), lambda f: contains(f, slots, F.col("text_hash"))))
    again = again.groupBy("text_hash").agg(F.first("text").alias("text")).withColumn("raw", tokens(F.col("text"))).withColumn("template", template(F.col("raw"))).drop("text")
    hint = F.broadcast if items.count() <= broadcast_windows // 16 else (lambda df: df)
    hits = _agreement(found.join(again, "text_hash").join(hint(items), "item_key"))
    # a text that merely looks like the template does not count, unless it is a copy nonetheless
    hits = hits.where(F.col("consistent") | (F.size("literal") >= share * F.col("n"))).select("text_hash", "item_key", "item_id", "n", "start", "same", (F.size("literal") == F.col("n")).alias("exact"))
    # the first part of one alignment and the second part of it or of another near it
    own = F.struct("start", "same")
    near = Window.partitionBy("text_hash", "item_key").orderBy("start").rangeBetween(-SHIFT, SHIFT)
    joint = lambda a, b: F.array_max(F.transform(F.sequence(F.lit(0), F.col("n")), lambda p: F.size(F.filter(a, lambda x: x < p)) + F.size(F.filter(b, lambda x: x >= p))))
    hits = hits.withColumn("others", F.collect_list(own).over(near))
    # two parts are needed only where no alignment near is enough by itself
    enough = lambda same: F.size(same) >= share * F.col("n")
    both = F.array_max(F.transform(F.filter("others", lambda o: o["start"] != F.col("start")), lambda o: joint(F.col("same"), o["same"])))
    alone = enough(F.col("same")) | F.exists("others", lambda o: enough(o["same"]))
    hits = hits.withColumn("covered", F.when(alone, F.size("same")).otherwise(F.greatest(F.size("same"), both)) / F.col("n"))
    best = hits.where(F.col("covered") >= share).groupBy("text_hash", "item_key").agg(F.first("item_id").alias("item_id"), F.max("covered").alias("covered"), F.max_by("start", F.struct("covered", F.size("same"), -F.col("start"))).alias("start"), F.max("exact").alias("exact"))
    return best.select("text_hash", "item_id", "covered", "start", "exact")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each (doc_id, item_id): the covered share of the item's tokens, its first token in the text, and whether it is literal."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    return found.join(ids, "text_hash").groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max_by(F.greatest("start", F.lit(0)), F.struct("covered", -F.col("start"))).cast("long").alias("start_word"), F.max("exact").alias("exact"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose text holds an item."""
    own = unused("leak_hash", docs.columns)
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("text_hash").alias(own)).distinct()
    return docs.join(bad, F.xxhash64(text_col) == F.col(own), "left_anti")
