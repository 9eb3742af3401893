"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, licenses, packing, preferences, quality_model, quality_rules, secrets, simhash, substrings
from .common import is_held_out, table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.scored(docs.select("doc_id", "text", is_held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen and 2k + 1 the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    return preferences.pairs(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 1)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.fit(docs)
    return language_id.predicted(docs.select("doc_id", is_held_out().alias("held_out"), "text"), filters)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_secret_scans": op4_secret_scans,
        "op5_quality_rules": op5_quality_rules,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_preference_formatting": op7_preference_formatting,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_preference_formatting": preferences.SQL}
