"""Cache-aside reads, write-through and write-back writes as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlume.functions.prefix import rank
from kvlume.operators import residency, versions
from kvlume.schemas import WRITE_BACK_BATCH


def lookup(requests: DataFrame, cache: DataFrame, backend: DataFrame) -> DataFrame:
    """Requests (seq, key) answered from the cache, else from the backend.

    ``admit`` marks the rows that a miss brings into the cache, clean.
    """
    c = cache.select("key", F.col("value").alias("_c"), F.lit(True).alias("_hit"))
    b = backend.select("key", F.col("value").alias("_b"), F.lit(True).alias("_stored"))
    hit, stored = F.coalesce("_hit", F.lit(False)), F.coalesce("_stored", F.lit(False))
    joined = requests.join(c, "key", "left").join(b, "key", "left")
    return joined.select("seq", "key", F.when(hit, F.col("_c")).otherwise(F.col("_b")).alias("value"), hit.alias("hit"), (hit | stored).alias("found"), (~hit & stored).alias("admit"))


def dirty(log: DataFrame, flushed_to: int) -> DataFrame:
    """Write-back: live keys whose newest write is later than the last flush."""
    return versions.latest(log).where(F.col("seq") > flushed_to)


def dirty_newest_first(log: DataFrame, flushed_to: int) -> DataFrame:
    return dirty(log, flushed_to).orderBy(F.desc("seq"))


def clear_dirty(state: DataFrame, flushed: DataFrame) -> DataFrame:
    """``state`` (key, seq, dirty) after a flush of ``flushed`` (key, seq): a flag
    goes only if the value written is still the current one."""
    done = flushed.select("key", F.col("seq").alias("_s"))
    return state.join(done, "key", "left").select("key", "seq", (F.col("dirty") & ~F.coalesce(F.col("_s") == F.col("seq"), F.lit(False))).alias("dirty"))


def batches(pending: DataFrame, size: int = WRITE_BACK_BATCH) -> DataFrame:
    """Dirty rows with the batch a flush writes them in, oldest first."""
    return rank(pending, "seq", "place").withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")


def backend_state(log: DataFrame, mode: str, flushed_to: int) -> DataFrame:
    """What the backend holds: all under write-through, all up to the last flush
    under write-back. Deletes reach it at once in both."""
    if mode == "write-through":
        return versions.latest(log)
    through = (F.col("seq") <= flushed_to) | (F.col("op") == "DEL")
    return versions.latest(log.where(through))


def flush_all(backend: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The backend with the cache's dirty rows in it, and an empty cache."""
    kept = versions.upsert(backend.select("key", "value"), cache.where("dirty").select("key", "value", "seq"))
    return kept, cache.limit(0)


def counters(log: DataFrame, answered: DataFrame, mode: str = "write-through") -> DataFrame:
    """Hits, misses and writes by mode, in one row."""
    reads = answered.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    puts = log.agg(F.count_if(F.col("op") == "PUT").alias("puts"))
    through = mode == "write-through"
    return reads.crossJoin(puts).select("cache_hits", "cache_misses", (F.col("puts") if through else F.lit(0).cast("long")).alias("write_through_ops"), (F.lit(0).cast("long") if through else F.col("puts")).alias("write_back_ops"))


def cached(log: DataFrame, capacity: int) -> DataFrame:
    """Residents of a delete-free trace of writes, with their newest values."""
    live = versions.latest(log)
    return residency.resident(live.select("segment", "key", "seq"), capacity).join(live.select("key", "value", "seq"), "key")
