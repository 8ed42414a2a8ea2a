"""Memtable accounting, flushes and compaction of sorted runs.

Tombstones are kept until the last level; newer runs win whatever order files
are listed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlume.functions.prefix import running_sum
from kvlume.operators.versions import newest, writes
from kvlume.schemas import ENTRY_OVERHEAD, FLUSH_BYTES, FRAME_OVERHEAD

#: What a number counts as, whatever its digits.
NUMBER_BYTES = 8


def value_bytes(log: DataFrame) -> Column:
    """Bytes of a write's value: text and binary by length, a number as eight, a
    null or a delete as none."""
    size = F.octet_length("value") if dict(log.dtypes)["value"] in ("string", "binary") else F.when(F.col("value").isNotNull(), NUMBER_BYTES)
    return F.when(F.col("op") == "PUT", F.coalesce(size, F.lit(0))).otherwise(0)


def entry_bytes(log: DataFrame) -> Column:
    """What a write costs in a memtable."""
    return (F.octet_length("key") + value_bytes(log) + ENTRY_OVERHEAD).cast("long")


def frame_bytes(log: DataFrame) -> Column:
    """What a write costs in the log file."""
    return (F.octet_length("key") + value_bytes(log) + FRAME_OVERHEAD).cast("long")


def epochs(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """Writes with ``epoch``: the memtable they fall in, counting from 0."""
    summed = running_sum(writes(log), "seq", entry_bytes(log), "bytes")
    return summed.withColumn("epoch", F.floor((F.col("bytes") - entry_bytes(log)) / threshold).cast("long"))


def memtables(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """Size and versions of each memtable, and whether it is due for a flush."""
    return epochs(log, threshold).groupBy("epoch").agg(F.sum(entry_bytes(log)).alias("approximate_size"), F.count(F.lit(1)).alias("entry_count")).withColumn("should_flush", F.col("approximate_size") >= threshold)


def flush(epoched: DataFrame) -> DataFrame:
    """Sorted runs of level 0, one per epoch: each key's newest write there."""
    runs = epoched.groupBy("epoch", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("r"), F.max("seq").alias("seq"))
    return runs.select(F.lit(0).alias("level"), F.col("epoch").alias("sst_id"), "key", "seq", "r.op", "r.value")


def compact(runs: DataFrame, next_id: int, into: int = 1, last_level: bool = False) -> DataFrame:
    """All runs merged into one of level ``into``."""
    merged = newest(runs.select("key", "seq", "op", "value"))
    if last_level:
        merged = merged.where(F.col("op") != "DEL")
    return merged.select(F.lit(into).alias("level"), F.lit(next_id).cast("long").alias("sst_id"), "key", "seq", "op", "value")


def needs_compaction(runs: DataFrame) -> DataFrame:
    n = F.count_distinct(F.when(F.col("level") == 0, F.col("sst_id")))
    return runs.agg(n.alias("level0_runs"), (n >= 2).alias("compact"))


def level_counts(runs: DataFrame) -> DataFrame:
    """Runs and entries by level, and in all (null level)."""
    per_run = runs.groupBy("level", "sst_id").agg(F.count(F.lit(1)).alias("n"))
    return per_run.rollup("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("entries"))


def write_runs(runs: DataFrame, path: str, files: int | None = None) -> None:
    """Runs as Parquet by level and run, sorted by key within files, with Bloom
    filters on the key; readers prune by partition, statistics and filter."""
    out = runs.repartition(*([files] if files else []), "level", "sst_id").sortWithinPartitions("level", "sst_id", "key")
    out.write.mode("errorifexists").option("parquet.bloom.filter.enabled#key", "true").partitionBy("level", "sst_id").parquet(path)
