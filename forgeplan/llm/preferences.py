"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of the two conversations, turn by turn (role and text), is rendered once as the prompt. What
follows in each is its completion, with the character spans that the assistant wrote as its mask: only these are
trained on, the marks of turns and other roles' words are not.

A conversation's turns are its rows by turn, then role, then text. Everything is column expressions: turns are
gathered for each pair (one row of output holds them anyway), compared by zipping, and rendered.

Cases: null texts are empty, null roles are `user`; null turns come first; repeated rows are turns of their own; a
conversation without a partner is returned with an empty partner, common prefix and prompt; two equal conversations
are all prompt; rows without an id belong to no conversation and are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, role: str = "assistant") -> Column:
    """`start:end` of each of the role's texts in the rendered turns, end marks included, comma-joined."""
    head = lambda t: len(OPEN) + F.length(t["role"]) + len(MIDDLE)

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(turns, start, add)["out"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("long")


def pairs(turns: DataFrame, pair: Column, rejected: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each value of `pair`; `rejected` tells the two conversations of a pair apart."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = turns.select(pair.alias("pair_id"), rejected.alias("rejected"), row.alias("row")).where(F.col("pair_id").isNotNull())
    plain = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("rejected") == F.lit(side), F.col("row")))), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    both = own.groupBy("pair_id").agg(plain(False).alias("a"), plain(True).alias("b"))
    both = both.withColumn("n", F.when((F.size("a") > 0) & (F.size("b") > 0), common_turns(F.col("a"), F.col("b"))).otherwise(F.lit(0)).cast("long"))
    rest = lambda c: F.slice(c, F.col("n").cast("int") + 1, F.greatest(F.size(c) - F.col("n").cast("int"), F.lit(0)))
    return both.select(
        "pair_id", F.col("n").alias("n_prompt_turns"), rendered(F.slice("a", F.lit(1), F.col("n").cast("int"))).alias("prompt"), rendered(rest("a")).alias("chosen"), rendered(rest("b")).alias("rejected"),
        mask(rest("a")).alias("chosen_mask"), mask(rest("b")).alias("rejected_mask"),
    )


#: The same for conversations 2k (chosen) and 2k + 1 (rejected).
SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT pair_id, count(DISTINCT side) AS sides, max(k) AS longest FROM t GROUP BY pair_id),
cut AS (
  SELECT i.pair_id, CASE WHEN i.sides < 2 THEN 0 ELSE coalesce((
    SELECT min(coalesce(a.k, b.k)) - 1 FROM (SELECT * FROM t WHERE side = 0) a
    FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
    WHERE coalesce(a.pair_id, b.pair_id) = i.pair_id AND (a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text)), i.longest) END AS n
  FROM ids i),
r AS (
  SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN cut USING (pair_id)),
p AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY k) AS upto FROM r WHERE k > n),
m AS (
  SELECT *, (upto - length(text) - 8)::BIGINT || ':' || upto::BIGINT AS span FROM p)
SELECT cut.pair_id, cut.n AS n_prompt_turns,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.pair_id = cut.pair_id AND side = 0 AND k <= r.n), '') AS prompt,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM p WHERE p.pair_id = cut.pair_id AND side = 0), '') AS chosen,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM p WHERE p.pair_id = cut.pair_id AND side = 1), '') AS rejected,
  coalesce((SELECT string_agg(span, ',' ORDER BY k) FROM m WHERE m.pair_id = cut.pair_id AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(span, ',' ORDER BY k) FROM m WHERE m.pair_id = cut.pair_id AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM cut
"""
