"""The flat key-value file: ``KEY \\t VALUE`` lines, the last of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlume.operators import versions


def load(spark: SparkSession, path: str) -> DataFrame:
    """key, value. Lines without a tab are skipped; values may hold more tabs.

    The order of lines is their place in the file: Spark hands out ids that
    ascend through the splits of a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("seq", F.monotonically_increasing_id())
    tab = F.instr("value", "\t")
    rows = lines.where(tab > 0).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("key"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"), "seq")
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def store(rows: DataFrame, path: str) -> None:
    """Writes key, value. Keys with tabs or line ends and values with line ends
    can't be read back, so they are refused."""
    bad = F.col("key").rlike("[\t\n\r]") | F.col("value").rlike("[\n\r]") | F.col("key").isNull() | F.col("value").isNull()
    checked = rows.select(F.when(bad, F.raise_error(F.lit("key or value can't be written to a flat file"))).otherwise(F.concat("key", F.lit("\t"), "value")).alias("line"))
    checked.write.mode("errorifexists").option("lineSep", "\n").text(path)


def merge(spark: SparkSession, path: str, batch: DataFrame, to: str) -> None:
    """``batch`` (key, value, seq) over the file at ``path``, written to ``to``."""
    store(versions.upsert(load(spark, path), batch), to)


def remove(spark: SparkSession, path: str, keys: DataFrame, to: str) -> None:
    store(versions.remove(load(spark, path), keys), to)
