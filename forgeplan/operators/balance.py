"""Checks of a plan: the balance of every item, and the plan's cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import Graph
from .normalize import net


def balances(g: Graph, executions: DataFrame, demand: DataFrame) -> DataFrame:
    """(query_id, item_id, balance, missing) over items touched or demanded; exact in DECIMAL(38,0).

    `executions`: (query_id, recipe_id, cnt); `demand`: (query_id, item_id, amount), stock as a negative amount.
    """
    made = net(g).join(executions, "recipe_id").select("query_id", "item_id", (F.col("coef").cast("decimal(38,0)") * F.col("cnt")).cast("decimal(38,0)").alias("x"))
    owed = demand.select("query_id", "item_id", (-F.col("amount")).cast("decimal(38,0)").alias("x"))
    total = made.unionByName(owed).groupBy("query_id", "item_id").agg(F.sum("x").cast("decimal(38,0)").alias("balance"))
    return total.withColumn("missing", F.greatest(-F.col("balance"), F.lit(0)).cast("decimal(38,0)"))


def costs(g: Graph, executions: DataFrame) -> DataFrame:
    """(query_id, objective, real_exec, tag_exec, distinct_recipes)."""
    real = F.col("anchor") <= g.n_real
    used = executions.where("cnt > 0").join(g.recipes, "recipe_id")
    return used.groupBy("query_id").agg(F.sum(F.col("cost") * F.col("cnt")).alias("objective"), F.sum(F.when(real, F.col("cnt")).otherwise(0)).alias("real_exec"), F.sum(F.when(real, 0).otherwise(F.col("cnt"))).alias("tag_exec"), F.countDistinct("recipe_id").alias("distinct_recipes"))
