"""Text tables around the planner: names, stock, targets, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["stage", "target", "amount", "stock", "repeat"]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(f) the tab-separated fields of every line that is neither blank nor a comment."""
    return spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))


def _number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("long"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(handle, resource_id, name_en, name_zh); lines without a positive handle are dropped."""
    rows = _fields(spark, path).select(_number(F.get("f", F.lit(0))).alias("handle"), *(F.coalesce(F.get("f", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(("resource_id", "name_en", "name_zh"), 1)))
    return rows.where("handle > 0")


def aliases(entries: DataFrame) -> DataFrame:
    """(alias, handle, ambiguous): ids and English names; the lowest handle answers to an alias that several share."""
    both = entries.select("handle", F.explode(F.array("resource_id", "name_en")).alias("alias")).where("alias <> ''")
    return both.groupBy("alias").agg(F.min("handle").alias("handle"), (F.countDistinct("handle") > 1).alias("ambiguous"))


def stock(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, amount): malformed lines are dropped, amounts of one handle are added up."""
    rows = _fields(spark, path).select(_number(F.get("f", F.lit(0))).alias("item_id"), _number(F.get("f", F.lit(1))).alias("amount"))
    return rows.where("item_id > 0 AND amount IS NOT NULL").groupBy("item_id").agg(F.sum("amount").alias("amount"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(handle, name, amounts, n_recipes, in_big_scc)."""
    at = lambda k: F.get("f", F.lit(k))
    return _fields(spark, path).select(_number(at(0)).alias("handle"), at(1).alias("name"), F.transform(F.split(at(2), ","), lambda x: x.try_cast("long")).alias("amounts"), _number(at(3)).alias("n_recipes"), _number(at(4)).alias("in_big_scc")).where("handle > 0")


def inventory(df: DataFrame, column: str, n_items: int) -> DataFrame:
    """`df` with `stock` (array of item_id and amount) and `error`, from text such as 3=10,7=1."""
    parts = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda p: p != "")
    of = lambda p, k: F.get(F.split(p, "="), F.lit(k)).try_cast("long")
    good = lambda p: p.rlike(r"^\d+=\d+$") & F.coalesce(of(p, 0).between(1, n_items), F.lit(False)) & of(p, 1).isNotNull()
    bad = F.exists(parts, lambda p: ~good(p))
    entries = F.transform(parts, lambda p: F.struct(of(p, 0).alias("item_id"), of(p, 1).alias("amount")))
    return df.withColumn("stock", F.when(~bad, entries)).withColumn("error", F.when(bad, "bad entry"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of JSON lines; malformed lines, such as a torn last one, are left out."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r"))
    return rows.where("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")


def missing_points(points: DataFrame, done: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The points that a resumed sweep still has to measure."""
    return points.join(done.select(*key).distinct(), key, "left_anti")


def replace_stage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of stages that were run again give way to the new ones."""
    return old.join(new.select("stage").distinct(), "stage", "left_anti").unionByName(new, allowMissingColumns=True)


def combined(parts: list[DataFrame], key: list[str] = KEY) -> DataFrame:
    """Rows of several runs, the earliest run's row for each key."""
    all_ = None
    for i, p in enumerate(parts):
        p = p.withColumn("_run", F.lit(i))
        all_ = p if all_ is None else all_.unionByName(p, allowMissingColumns=True)
    first = Window.partitionBy(*key).orderBy("_run")
    return all_.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_run")


def points(stages: list[str], targets: DataFrame, amounts: list[int], stocks: list[str], repeats: int) -> DataFrame:
    """Every stage with every target, amount, stock group and repetition; the lists are short and given."""
    lists = (("stage", stages), ("amount", amounts), ("stock", stocks), ("repeat", list(range(repeats))))
    out = targets.select(F.col("handle").alias("target"))
    for name, values in lists:
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out
