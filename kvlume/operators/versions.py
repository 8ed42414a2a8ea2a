"""Latest-wins materialisation of a versioned operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def writes(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") != "GET")


def newest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Each key's newest write, tombstones included. One partial and one final
    aggregate; the columns travel in a struct."""
    rest = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"), F.max(seq).alias(seq)).select(key, seq, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest(log: DataFrame) -> DataFrame:
    """Live keys with their newest value."""
    return newest(writes(log)).where(F.col("op") == "PUT")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live keys as they were after operation ``seq``."""
    return latest(log.where(F.col("seq") <= seq))


def deleted(log: DataFrame) -> DataFrame:
    """Keys whose newest write is a delete."""
    return newest(writes(log)).where(F.col("op") == "DEL")


def versions(log: DataFrame) -> DataFrame:
    """All writes with ``version``: 1 is a key's newest."""
    newest_first = Window.partitionBy("key").orderBy(F.desc("seq"))
    return writes(log).withColumn("version", F.row_number().over(newest_first).cast("long"))


def scan(log: DataFrame) -> DataFrame:
    """The ordered scan: key ascending, newest version first."""
    return writes(log).orderBy("key", F.desc("seq"))


def tiered(tiers: DataFrame) -> DataFrame:
    """Lookup through tiers (priority, sst_id, seq, key, op, value): the first
    tier that knows a key wins, and a tombstone there ends the search.

    The winner is an ordered maximum, so no window is sorted.
    """
    order = F.struct((-F.col("priority")).alias("p"), "sst_id", "seq")
    best = tiers.groupBy("key").agg(F.max_by(F.struct("priority", "op", "value", "seq"), order).alias("r"))
    return best.select("key", "r.*").where(F.col("op") == "PUT")


def upsert(base: DataFrame, batch: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """``base`` with the rows of ``batch`` over it; within the batch the last wins."""
    rest = [c for c in base.columns if c != key]
    both = base.withColumn("_side", F.lit(0)).withColumn(order, F.lit(-1).cast("long")).unionByName(batch.select(*base.columns, order).withColumn("_side", F.lit(1)))
    won = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_side", order)).alias("r"))
    return won.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def remove(base: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def next_sequence(log: DataFrame) -> DataFrame:
    """Recovery: how many records there are and the sequence number to go on with."""
    return log.agg(F.count(F.lit(1)).alias("replayed"), (F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))
