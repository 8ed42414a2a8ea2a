"""Pluggable backends of a cache: load, store, remove, batch_store, ping."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlume.operators import versions


class Backend(Protocol):
    def load(self, keys: DataFrame) -> DataFrame: ...

    def batch_store(self, rows: DataFrame) -> None: ...

    def remove(self, keys: DataFrame) -> None: ...

    def size(self) -> int: ...

    def ping(self) -> bool: ...


class LogBackend:
    """An append-only Parquet log (seq, key, op, value); reads are latest-wins.

    Appends commit as files, so a failed write shows as an error and is never
    half visible; replaying a batch of the same seqs changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        schema = "seq long, key string, op string, value string"
        return self.spark.read.schema(schema).parquet(self.path) if self.ping() else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame) -> None:
        rows.select(F.col("seq").cast("long"), "key", "op", "value").write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        return versions.latest(self.log())

    def load(self, keys: DataFrame) -> DataFrame:
        """The keys with ``value``, null for a miss, and ``found``."""
        have = self.latest().select("key", "value", F.lit(True).alias("found"))
        return keys.select("key").join(have, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def batch_store(self, rows: DataFrame) -> None:
        self._append(rows.withColumn("op", F.lit("PUT")))

    def remove(self, keys: DataFrame) -> None:
        self._append(keys.withColumn("op", F.lit("DEL")).withColumn("value", F.lit(None).cast("string")))

    def size(self) -> int:
        return self.latest().count()

    def ping(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def compact(self) -> str:
        """Rewrites the newest versions beside the log, swaps, and only then drops
        the old files; returns the new path."""
        new = f"{self.path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
        versions.newest(self.log()).write.parquet(new)
        old, self.path = self.path, new
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return new
