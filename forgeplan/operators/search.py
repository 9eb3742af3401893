"""Ranked name search over id, English and Chinese names with pinyin, for a table of queries at once.

A score is (kind, minor readings, field, position, span, handle), smallest first; each entry counts with its best.
Queries are few and broadcast against the names, which stay where they are; all matching is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import folded, pinyin_variants, tokens

EXACT, PREFIX, CONTAINS, SUBSEQUENCE, INITIALS, WORD_SUBSTRING = range(6)
FIELDS = {"en": 0, "zh": 1, "id": 2}
SCORE = "struct<kind:int,weight:int,field:int,position:int,span:int>"
VARIANT = StructType([StructField("syllables", ArrayType(StringType())), StructField("weight", IntegerType())])


def indexed(names: DataFrame, readings: dict[str, list[str]] | None = None) -> DataFrame:
    """`names` (handle, resource_id, name_en, name_zh) with tokens and pinyin variants, made once for an index."""
    table = readings or {}
    variants = F.udf(lambda s: pinyin_variants(s or "", table), ArrayType(VARIANT)) if table else None
    return names.select(
        "handle", tokens(F.col("resource_id")).alias("id_tokens"), tokens(F.col("name_en")).alias("en_tokens"), folded(F.col("name_zh")).alias("zh"),
        (variants(folded(F.col("name_zh"))) if table else F.array().cast("array<struct<syllables:array<string>,weight:int>>")).alias("variants"),
    )


def _score(kind, field: str, position: Column, span: Column, weight=0) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(as_int(kind).alias("kind"), as_int(weight).alias("weight"), F.lit(FIELDS[field]).cast("int").alias("field"), as_int(position).alias("position"), as_int(span).alias("span"))


def _greedy(places: Column, query: Column, fits) -> Column:
    """Walks the query's tokens over `places`, each to the first later place that fits: struct(first, last, gaps, full, ok)."""
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("gaps"), F.lit(True).alias("full"), F.lit(True).alias("ok"))

    def step(acc: Column, q: Column) -> Column:
        ahead = F.slice(places, acc["last"] + 2, F.greatest(F.size(places) - acc["last"] - 1, F.lit(0)))
        at = F.array_position(F.transform(ahead, lambda p: fits(p, q)), True).cast("int")
        here = acc["last"] + at
        return F.struct(
            F.when(acc["first"] < 0, here).otherwise(acc["first"]).alias("first"), here.alias("last"), (acc["gaps"] + F.when((acc["first"] >= 0) & (at > 1), 1).otherwise(0)).alias("gaps"),
            (acc["full"] & F.coalesce(F.get(places, here) == q, F.lit(False))).alias("full"), (acc["ok"] & (at > 0)).alias("ok"),
        )

    return F.aggregate(query, start, step)


def sparse(field: str, entry: Column, query: Column) -> Column:
    """Every query token begins a later entry token; a single one may also lie inside a token."""
    begin = _greedy(entry, query, lambda p, q: F.startswith(p, q))
    inside = _greedy(entry, query, lambda p, q: F.contains(p, q))
    pick = F.transform(F.array(F.struct(begin.alias("b"), inside.alias("i"))), lambda x: F.when(
        x["b"]["ok"],
        _score(
            F.when((x["b"]["first"] == 0) & (x["b"]["gaps"] == 0) & x["b"]["full"] & (x["b"]["last"] == F.size(entry) - 1), EXACT).when((x["b"]["first"] == 0) & (x["b"]["gaps"] == 0), PREFIX).when(x["b"]["gaps"] == 0, CONTAINS).otherwise(SUBSEQUENCE),
            field, x["b"]["first"], x["b"]["last"] - x["b"]["first"] + 1,
        ),
    ).when((F.size(query) == 1) & x["i"]["ok"], _score(WORD_SUBSTRING, field, x["i"]["first"], x["i"]["last"] - x["i"]["first"] + 1)))
    return pick[0]


def chinese(zh: Column, query: Column) -> Column:
    """Query tokens as ordered substrings of the name; places count bytes."""
    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("end"), F.lit(True).alias("near"), F.lit(True).alias("ok"))

    def step(acc: Column, q: Column) -> Column:
        at = F.instr(F.substring(zh, acc["end"] + 1, F.length(zh)), q)
        begin = acc["end"] + at - 1
        return F.struct(F.when(acc["first"] < 0, begin).otherwise(acc["first"]).alias("first"), (begin + F.length(q)).alias("end"), (acc["near"] & ((acc["first"] < 0) | (at == 1))).alias("near"), (acc["ok"] & (at > 0)).alias("ok"))

    nbytes = lambda upto: F.octet_length(F.substring(zh, F.lit(1), upto))
    return F.transform(F.array(F.aggregate(query, start, step)), lambda m: F.when(
        m["ok"] & zh.isNotNull(),
        _score(F.when((F.size(query) == 1) & (m["first"] == 0) & (m["end"] == F.length(zh)), EXACT).when(m["first"] == 0, PREFIX).when((F.size(query) == 1) | m["near"], CONTAINS).otherwise(SUBSEQUENCE), "zh", nbytes(m["first"]), nbytes(m["end"]) - nbytes(m["first"])),
    ))[0]


def pinyin(variant: Column, query: Column) -> Column:
    """Query tokens begin at syllables of the joined reading and may end within one; places count syllables, spans characters."""
    syllables = variant["syllables"]
    size = F.size(syllables)
    rest = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.array_join(F.slice(syllables, i + 1, size - i), ""))
    whole = F.length(F.get(rest, F.lit(0)))
    offset = lambda i: whole - F.length(F.get(rest, i))
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("end"), F.lit(True).alias("near"), F.lit(True).alias("ok"))

    def step(acc: Column, q: Column) -> Column:
        ahead = F.slice(rest, acc["last"] + 2, F.greatest(size - acc["last"] - 1, F.lit(0)))
        at = F.array_position(F.transform(ahead, lambda p: F.startswith(p, q)), True).cast("int")
        here = acc["last"] + at
        return F.struct(F.when(acc["first"] < 0, here).otherwise(acc["first"]).alias("first"), here.alias("last"), F.coalesce(offset(here) + F.length(q), F.lit(0)).alias("end"), (acc["near"] & ((acc["first"] < 0) | F.coalesce(offset(here) == acc["end"], F.lit(False)))).alias("near"), (acc["ok"] & (at > 0)).alias("ok"))

    return F.transform(F.array(F.aggregate(query, start, step)), lambda m: F.when(
        m["ok"],
        _score(F.when((m["first"] == 0) & (F.size(query) == 1) & (m["end"] == whole), EXACT).when(m["first"] == 0, PREFIX).when((F.size(query) == 1) | m["near"], CONTAINS).otherwise(SUBSEQUENCE), "zh", m["first"], m["end"] - offset(m["first"]), variant["weight"]),
    ))[0]


def initials(variant: Column, query: Column) -> Column:
    letters = F.array_join(F.transform(variant["syllables"], lambda s: F.left(s, F.lit(1))), "")
    at = F.instr(letters, F.get(query, F.lit(0)))
    return F.when((F.size(query) == 1) & (at > 0), _score(INITIALS, "zh", at - 1, F.length(F.get(query, F.lit(0))), variant["weight"]))


def search(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, handle, kind) of the best `limit` entries of each query (query_id, query)."""
    q = queries.select("query_id", tokens(F.col("query")).alias("q"), F.col("query").rlike(r"[^\x00-\x7F]").alias("wide")).where(F.size("q") > 0)
    # names are short and their files few: dealt out, no task has a file's share of the matching
    both = index.repartition(8 * index.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(q))
    query = F.col("q")
    found = F.concat(
        F.array(sparse("en", F.col("en_tokens"), query), sparse("id", F.col("id_tokens"), query), F.when(F.col("wide"), chinese(F.col("zh"), query))),
        F.transform("variants", lambda v: pinyin(v, query)), F.transform("variants", lambda v: initials(v, query)),
    )
    scored = both.select("query_id", "handle", F.array_min(F.filter(found, lambda s: s.isNotNull())).alias("score")).where("score is not null")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "handle"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "handle", F.col("score.kind").alias("kind"))
