"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only in local mode, and only where none is configured."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class Stage:
    """A table written to the shared folder: lineage ends here, so lost executors cost a reread only.

    Its folder goes with `drop`, or when the application ends.
    """

    def __init__(self, df: DataFrame, name: str, *measures: Column):
        """`measures` are taken of the rows while they are written, and kept by name in `measured`."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        seen = Observation() if measures else None
        fs, target = _folder(self.spark, self.path)
        fs.deleteOnExit(target)
        (df.observe(seen, *measures) if seen else df).write.parquet(self.path)
        self.measured = seen.get if seen else {}
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        fs, target = _folder(self.spark, self.path)
        fs.delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    return Stage(df, name).df


def unused(name: str, columns: Iterable[str]) -> str:
    """`name`, with underscores before it until no column has it (Spark's names have no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """`rows` with the columns of `lookup`, which has one row a key and tells in `count` how many `rows` have it.

    Rows of a key with more than one part in `share` of all `total` rows meet a broadcast copy of its row, so they
    stay where they are; there are less than `share` such keys whatever the data. The others are joined by a shuffle.
    """
    hot = F.col(count) > max(total // share, 1)
    few = F.broadcast(lookup.where(hot).drop(count))
    cold = rows.join(few.select(key), key, "left_anti").join(lookup.where(~hot).drop(count), key)
    return rows.join(few, key).unionByName(cold)


def is_held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels no model may see."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def chunks(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of `batch` whose texts have about `most` bytes; a longer text stands alone."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space as (row of each word, code of each word, the distinct words)."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    coded = pc.filter(flat, full).dictionary_encode()
    return rows[keep], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batches(rows: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)
