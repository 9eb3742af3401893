"""A training corpus from `documents`: rejected, near-duplicate and contaminated documents go, secrets are masked, the rest is packed.

Each stage is written to the shared folder and read back as the next one's documents. All but the last return the
columns of `documents`; other columns of the input do not reach the stages. Cases, for every stage: an empty table
gives an empty one; ids may be null or repeated, and rows are judged by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeplan.llm import decontamination, packing, quality_model, secrets, simhash
from forgeplan.llm.common import Stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents that reach this stage.

    Null and blank texts have the score of the intercept; repeated rows have one score, a score of exactly 0.5 stays.
    """
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs.select(*COLUMNS), model, out="_score").where("_score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id.

    Null and blank texts are one group; rows without an id stay only if no row of their group has one; of rows with
    equal id and text one stays.
    """
    return simhash.deduplicated(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and blank texts hold none; repeated rows go or stay together."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the new text. Null texts stay null, with null n_chars."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with the training sequence that holds it.

    Null and blank texts have no piece; repeated rows are packed as often as they occur.
    """
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: No SQL: the fitted classifier, the components and the packing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stage(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return docs
