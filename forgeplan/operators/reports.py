"""Reports over measured plans: joined with the truth, tallied and averaged by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses that count as an answer, and those of a request that had a plan.
ANSWERED = ("ok", "missing", "infeasible")


def derived(rows: DataFrame) -> DataFrame:
    """`rows` (status, proven_optimal, plan_ms, query_ms, reach_ms, solve_ms, ...) with optimality, no_answer and one plan_ms."""
    optimal = F.when(F.col("status").isin("ok", "missing"), F.when(F.col("proven_optimal"), "proven").otherwise("unclaimed")).otherwise("no_plan")
    spent = F.coalesce("plan_ms", "query_ms", F.coalesce("reach_ms", F.lit(0.0)) + F.coalesce("solve_ms", F.lit(0.0)))
    return rows.withColumn("optimality", optimal).withColumn("no_answer", ~F.col("status").isin(*ANSWERED)).withColumn("plan_ms", spent)


def with_truth(rows: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Rows with `true_feasible` and `best_cost` of their point, and the ratio of their cost to it."""
    joined = rows.join(truth.select(*key, "true_feasible", "best_cost"), key, "left")
    return joined.withColumn("cost_ratio", F.when((F.col("status") == "ok") & (F.col("best_cost") > 0), F.col("cost") / F.col("best_cost")))


def summary(rows: DataFrame, by: list[str], statistic: str = "median") -> DataFrame:
    """One row a group of tallies, agreement with the truth, and the median, mean or max of time and cost ratio."""
    of = {"median": lambda c: F.percentile(c, F.lit(0.5)), "mean": F.avg, "max": F.max}[statistic]
    count = lambda c: F.count_if(c).alias
    feasible, known = F.col("status") == "ok", F.col("true_feasible").isNotNull() & ~F.col("no_answer")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        count(feasible)("feasible"),
        count(F.col("optimality") == "proven")("proven"),
        count(F.col("optimality") == "unclaimed")("unproven"),
        count(F.col("no_answer"))("no_answer"),
        count(known)("compared"),
        count(known & (feasible == F.col("true_feasible")))("agree"),
        count(known & feasible & ~F.col("true_feasible"))("false_positive"),
        of(F.col("plan_ms")).cast("double").alias("plan_ms"),
        of(F.col("cost_ratio")).cast("double").alias("cost_ratio"),
    )


def missing_lists(balances: DataFrame, shown: int = 12) -> DataFrame:
    """(query_id, n_missing, shortfalls): the largest shortfalls first, ties by item, at most `shown` of them."""
    short = balances.where("missing > 0")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("missing")).alias("m"), "item_id")))
    return short.groupBy("query_id").agg(F.count("*").alias("n_missing"), F.transform(F.slice(ordered, 1, shown), lambda x: F.struct(x["item_id"].alias("item_id"), (-x["m"]).cast("long").alias("missing"))).alias("shortfalls"))


def fingerprint(spark, path: str) -> DataFrame:
    """(path, sha256) of the files at `path`."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
