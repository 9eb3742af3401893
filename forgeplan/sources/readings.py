"""A table of pinyin readings from lines such as U+77F3: shí,dàn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vowels with tone marks and the letters below them; the characters covered.
MARKED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜńňǹḿê"
PLAIN = "aaaaeeeeiiiioooouuuuüüüünnnme"
COVERED = (0x4E00, 0x9FA5)


def readings(spark: SparkSession, path: str) -> DataFrame:
    """(character, readings): without tones, in the file's order, each once; a ü is written v and u. Other lines are skipped."""
    found = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r"^U\+([0-9A-F]{4,5}):\s*([^#]+?)\s*(?:#|$)"), 1).alias("code"), F.regexp_extract("value", r"^U\+[0-9A-F]{4,5}:\s*([^#]+?)\s*(?:#|$)", 1).alias("said"))
    point = F.conv(F.get("code", F.lit(0)), 16, 10).cast("int")
    plain = F.filter(F.split(F.translate(F.lower("said"), MARKED, PLAIN), r"\s*,\s*"), lambda r: r != "")
    spelt = F.flatten(F.transform(plain, lambda r: F.when(r.contains("ü"), F.array(F.replace(r, F.lit("ü"), F.lit("v")), F.replace(r, F.lit("ü"), F.lit("u")))).otherwise(F.array(r))))
    rows = found.withColumn("point", point).where(F.col("point").between(*COVERED))
    return rows.select(F.decode(F.unhex(F.lpad(F.hex("point"), 8, "0")), "UTF-32").alias("character"), F.array_distinct(spelt).alias("readings"))
