"""Structured Streaming forms of the timer-driven parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from kvlume.operators import versions
from kvlume.operators.residency import Lru
from kvlume.sources.backend import LogBackend

LOG = "seq long, key string, op string, value string"


def read_log(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path)


def write_back(log: DataFrame, backend: LogBackend, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Flushes each micro-batch's newest writes to the backend. Without a period
    it drains what there is and stops. A batch that is repeated after a failure
    stores the same seqs again, which changes nothing."""

    def flush(batch: DataFrame, _id: int) -> None:
        backend._append(versions.newest(versions.writes(batch)))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def segment_load(events: DataFrame, period: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations by event-time window and segment; rows later than ``late`` are
    dropped once their window has closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", period), "segment").agg(F.count(F.lit(1)).alias("ops")).select(F.col("window.start").alias("start"), "segment", "ops")


class LruState(StatefulProcessor):
    """A segment's cache as keyed state. Rows of a batch are applied in ``seq``
    order; batches must come in that order."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "key string", "place long, value string, dirty boolean")
        self.clock = handle.getValueState("clock", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = Lru(self.capacity)
        for k, v in sorted(self.rows.iterator(), key=lambda x: x[1][0]):
            cache.rows[k[0]] = (v[1], v[2])
        before = dict(cache.rows)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            hit = r.key in cache.rows
            if r.op == "PUT":
                cache.put(r.key, r.value)
            elif r.op == "DEL":
                cache.delete(r.key)
            else:
                cache.get(r.key)
            gone = cache.evicted.pop()[0] if cache.evicted else None
            out.append((key[0], r.seq, hit, gone))
        at = self.clock.get()[0] if self.clock.exists() else 0
        for k in before:
            if k not in cache.rows:
                self.rows.removeKey((k,))
        for i, (k, (value, dirty)) in enumerate(cache.rows.items()):
            self.rows.updateValue((k,), (at + i, value, dirty))
        self.clock.update((at + len(cache.rows),))
        yield pd.DataFrame(out, columns=["segment", "seq", "hit", "evicted"])

    def close(self) -> None:
        pass


def lru(log: DataFrame, capacity: int) -> DataFrame:
    """segment, seq, hit, evicted of a stream (segment, seq, key, op, value). The
    session needs the RocksDB state store."""
    return log.groupBy("segment").transformWithStateInPandas(LruState(capacity), "segment int, seq long, hit boolean, evicted string", "Append", "None")


def drain(df: DataFrame, each: Callable[[DataFrame], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and waits for its end."""
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _i: each(b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
