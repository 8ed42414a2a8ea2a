"""LRU residency, hits and evictions per hash segment.

Without deletes, residency is a set computation: a segment of capacity C holds
the C keys with the newest accesses.  Hits of a whole trace are found in
parallel chunks: only the C newest keys of a chunk can matter to later ones, so
chunk summaries of bounded size are folded in order, in two levels, and each
chunk is then replayed on its own from the state it starts with.  With deletes the rules are
sequential per segment and a fold replays them.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlume.schemas import SEGMENTS


def last_access(log: DataFrame) -> DataFrame:
    return log.groupBy("segment", "key").agg(F.max("seq").alias("last_access_seq"))


def recency(log: DataFrame) -> DataFrame:
    """Keys with ``recency``: 1 is a segment's most recently used key."""
    newest_first = Window.partitionBy("segment").orderBy(F.desc("last_access_seq"))
    return last_access(log).withColumn("recency", F.row_number().over(newest_first).cast("long"))


def resident(log: DataFrame, capacity: int) -> DataFrame:
    """Keys in cache after a delete-free trace. The rank filter lets Spark keep
    ``capacity`` rows a segment before the shuffle."""
    return recency(log).where(F.col("recency") <= capacity)


def eviction_order(log: DataFrame, capacity: int) -> DataFrame:
    """Resident keys with ``evict``: 1 goes first."""
    oldest_first = Window.partitionBy("segment").orderBy("last_access_seq")
    return resident(log, capacity).withColumn("evict", F.row_number().over(oldest_first).cast("long")).drop("recency")


def ends(log: DataFrame) -> DataFrame:
    """Each segment's most and least recently used keys and its size."""
    return last_access(log).groupBy("segment").agg(F.max_by("key", "last_access_seq").alias("mru"), F.min_by("key", "last_access_seq").alias("lru"), F.count(F.lit(1)).alias("keys"))


def segment_sizes(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """Keys per segment, empty segments included."""
    counted = keys.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(SEGMENTS).select(F.col("id").cast("int").alias("segment"))
    return every.join(counted, "segment", "left").select("segment", F.coalesce("n", F.lit(0).cast("long")).alias("keys"))


def hits(log: DataFrame, capacity: int, chunk: int = 20_000, group: int = 1_000, parts: int | None = None) -> DataFrame:
    """``seq``, ``segment``, ``key`` and ``hit`` of a delete-free trace in which
    every access admits its key; exact, by chunks of ``chunk`` sequence numbers.
    Chunk summaries are folded within groups of ``group`` chunks, and group
    summaries before them, so no task holds those of a whole trace. The accesses
    are dealt out once, to ``parts`` tasks, for both the summaries and the replay."""
    pair, dealt_to = ("segment", "chunk"), (parts,) if parts else ()
    chunked = log.select("segment", F.floor(F.col("seq") / chunk).cast("long").alias("chunk"), "seq", "key").repartition(*dealt_to, *pair)
    last = chunked.groupBy(*pair, "key").agg(F.max("seq").alias("at"))
    newest_first = Window.partitionBy(*pair).orderBy(F.desc("at"))
    newest = last.withColumn("r", F.row_number().over(newest_first)).where(F.col("r") <= capacity)
    summary = newest.select("segment", F.floor(F.col("chunk") / group).cast("long").alias("group"), "key", "at").repartition(*dealt_to, "segment", "group")

    def fold_(pdf: pd.DataFrame, held: OrderedDict, width: int) -> pd.DataFrame:
        """What is held before each chunk of ``width`` numbers, oldest first, if
        ``held`` is at first."""
        out, ordered = [], pdf.sort_values("at")
        for number, own in ordered.groupby(ordered["at"] // width, sort=True):
            out.append((int(pdf["segment"].iloc[0]), number, list(held)))
            for key in own["key"]:
                held.pop(key, None)
                held[key] = True
                if len(held) > capacity:
                    held.popitem(last=False)
        return pd.DataFrame(out, columns=["segment", "chunk", "held"])

    def within(key, own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["segment", "chunk", "held"])
        return fold_(own, OrderedDict((k, True) for k in (state["held"].iloc[0] if len(state) else [])), chunk)

    held = "segment int, chunk long, held array<string>"
    by_group = summary.groupBy("segment", "group", "key").agg(F.max("at").alias("at"))
    newest_of_group = Window.partitionBy("segment", "group").orderBy(F.desc("at"))
    groups = by_group.withColumn("r", F.row_number().over(newest_of_group)).where(F.col("r") <= capacity).select("segment", "key", "at")
    first = groups.groupBy("segment").applyInPandas(lambda pdf: fold_(pdf, OrderedDict(), chunk * group), held).withColumnRenamed("chunk", "group")
    begin = summary.groupBy("segment", "group").cogroup(first.groupBy("segment", "group")).applyInPandas(within, held)

    def replay(key, accesses: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        held = OrderedDict((k, True) for k in (state["held"].iloc[0] if len(state) else []))
        own = accesses.sort_values("seq")
        found = []
        for k in own["key"]:
            hit = k in held
            found.append(hit)
            if hit:
                held.move_to_end(k)
            else:
                held[k] = True
                if len(held) > capacity:
                    held.popitem(last=False)
        return own.assign(hit=found)[["seq", "segment", "key", "hit"]]

    return chunked.groupBy(*pair).cogroup(begin.groupBy(*pair)).applyInPandas(replay, "seq long, segment int, key string, hit boolean")


class Lru:
    """The rules of one segment's cache; ``evicted`` collects what left it."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.rows, self.evicted = capacity, OrderedDict(), []

    def get(self, key):
        row = self.rows.get(key)
        if row is not None:
            self.rows.move_to_end(key)
        return row

    def put(self, key, value, dirty=True):
        if key not in self.rows and len(self.rows) >= self.capacity:
            self.evicted.append((*self.rows.popitem(last=False),))
        self.rows[key] = (value, dirty)
        self.rows.move_to_end(key)

    def delete(self, key) -> bool:
        if key not in self.rows:
            return False
        self.evicted.append((key, self.rows.pop(key)))
        return True

    def clear_dirty(self, key):
        if key in self.rows:
            self.rows[key] = (self.rows[key][0], False)

    def clear(self):
        self.evicted += self.rows.items()
        self.rows.clear()


FOLD = "seq long, segment int, key string, op string, hit boolean, evicted string, evicted_value double, evicted_dirty boolean"


def fold(log: DataFrame, capacity: int) -> DataFrame:
    """Every operation of a trace with deletes: whether it hit, and what it threw
    out (a delete hands its own row to the eviction hook). GET admits nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, out = Lru(capacity), []
        for r in pdf.sort_values("seq").itertuples():
            hit = r.key in cache.rows
            if r.op == "GET":
                cache.get(r.key)
            elif r.op == "PUT":
                cache.put(r.key, r.value)
            else:
                cache.delete(r.key)
            gone = cache.evicted.pop() if cache.evicted else (None, (None, None))
            out.append((r.seq, r.segment, r.key, r.op, hit, gone[0], gone[1][0], gone[1][1]))
        return pd.DataFrame(out, columns=[f.split()[0] for f in FOLD.split(", ")])

    return log.select("seq", "segment", "key", "op", "value").groupBy("segment").applyInPandas(run, FOLD)
