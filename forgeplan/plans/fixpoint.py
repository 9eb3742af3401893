"""Tables that end a lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only in local mode, and only where none is configured."""
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the folder that all executors share, and read back; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A set that grows by rounds: each round's rows are written once, and all rounds are read together."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name = first.sparkSession, first.schema, name
        self.folder = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
        self.latest = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows of this round, which must be new, read back."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        rows.select(*self.schema.names).write.parquet(self.paths[-1])
        self.latest = self.spark.read.schema(self.schema).parquet(self.paths[-1])
        return self.latest

    @property
    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
