"""Per-shard load: counts, hot shards, telemetry and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlume.functions.prefix import rank, running_sum
from kvlume.schemas import EVENT_RING, MAX_RATE, SEGMENTS, TELEMETRY_RING, TRAIN_BATCH, TRAIN_MINIMUM


def shards(spark: SparkSession) -> DataFrame:
    return spark.range(SEGMENTS).select(F.col("id").cast("int").alias("shard"))


def shard_ops(spark: SparkSession, ops: DataFrame) -> DataFrame:
    """Operations per shard, idle shards included."""
    return shards(spark).join(ops.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard", "left").select("shard", F.coalesce("n", F.lit(0).cast("long")).alias("ops"))


def hot_shards(counts: DataFrame, factor: float) -> DataFrame:
    """Shards above ``factor`` times the mean over all shards."""
    mean = counts.agg((F.sum("ops") / SEGMENTS).alias("mean"))
    return counts.join(F.broadcast(mean)).where(F.col("ops") > F.col("mean") * factor)


def bursts(ops: DataFrame, order: str, window: int, factor: float = 2.5, least: int = 50, burst: int = 2, stroke: int = 4) -> DataFrame:
    """Tumbling windows of ``window`` operations: total, hot shards, verdict."""
    placed = rank(ops, order, "_p").withColumn("window", F.floor((F.col("_p") - 1) / window).cast("long"))
    per = placed.groupBy("window", "shard").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("window")
    marked = per.withColumn("total", F.sum("n").over(total))
    out = marked.groupBy("window", "total").agg(F.count_if(F.col("n") > F.col("total") / SEGMENTS * factor).alias("hot"))
    busy = F.col("total") > least
    return out.select("window", "total", "hot", (busy & (F.col("hot") >= burst)).alias("burst"), (busy & (F.col("hot") >= stroke)).alias("heat_stroke"))


def with_cooldown(found: DataFrame, checks: int = 10) -> DataFrame:
    """Bursts that are reported: after one, the next ``checks`` checks (windows with
    more than 50 operations) are mute.

    A burst more than ``checks`` checks after the burst before it is reported in
    any case, so runs of closer bursts are judged apart from one another.
    """
    busy = rank(found.where(F.col("total") > 50).select("window", "burst"), "window", "check")
    bursts_ = rank(busy.where("burst").select("window", "check"), "window", "number")
    before = bursts_.select((F.col("number") + 1).alias("number"), F.col("check").alias("_before"))
    apart = F.when(F.col("check") - F.col("_before") <= checks, 0).otherwise(1).cast("long")
    runs = running_sum(bursts_.join(before, "number", "left"), "number", apart, "run").select("window", "check", "run")

    def judge(pdf):
        out, mute_to = [], -1
        for r in pdf.sort_values("check").itertuples():
            out.append(r.check > mute_to)
            mute_to = r.check + checks if out[-1] else mute_to
        return pdf.sort_values("check").assign(reported=out)[["window", "reported"]]

    reported = runs.groupBy("run").applyInPandas(judge, "window long, reported boolean")
    return found.join(reported, "window", "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def burst_stop(counts: DataFrame) -> DataFrame:
    """The verdict when a persistent burst ends: three times the mean is hot."""
    mean = counts.agg(F.when(F.sum("ops") > 0, F.sum("ops") / SEGMENTS).otherwise(1.0).alias("mean"))
    hot = counts.join(F.broadcast(mean)).agg(F.count_if(F.col("ops") > F.col("mean") * 3.0).alias("hot_detected"))
    return hot.select("hot_detected", (F.col("hot_detected") >= 2).alias("burst"), (F.col("hot_detected") >= 3).alias("heat_stroke"))


def peak_shard(loads: DataFrame) -> DataFrame:
    """The shard with the largest load, the lowest of several; 0 if none is over 0."""
    best = loads.agg(F.max(F.struct(F.col("load"), (-F.col("shard")).alias("s"))).alias("b"))
    some = F.coalesce(F.col("b.load") > 0, F.lit(False))
    return best.select(F.when(some, -F.col("b.s")).otherwise(0).alias("shard"), F.when(some, F.col("b.load")).otherwise(0.0).alias("load"))


def telemetry(ops: DataFrame, tick: Column, capacity: int, hit_rate: Column) -> DataFrame:
    """Load, hit rate and latency of each shard and tick, idle shards included,
    from operations (shard, key and hit). A shard's size is the keys it has seen
    so far; the hit rate is that of all shards.
    """
    ticked = ops.withColumn("tick", tick)
    every = ticked.select("tick").distinct().select("tick", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("shard"))
    per = every.join(ticked.groupBy("tick", "shard").agg(F.count(F.lit(1)).alias("n")), ["tick", "shard"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    first = ticked.groupBy("shard", "key").agg(F.min("tick").alias("tick")).groupBy("tick", "shard").agg(F.count(F.lit(1)).alias("new_keys"))
    running = Window.partitionBy("shard").orderBy("tick")
    size = F.sum(F.coalesce("new_keys", F.lit(0))).over(running)
    rate = ticked.groupBy("tick").agg(F.avg(hit_rate).alias("hit_rate"))
    busiest = F.greatest(F.max("n").over(Window.partitionBy("tick")), F.lit(1))
    out = per.join(first, ["tick", "shard"], "left").withColumn("size", size).withColumn("ops_load", F.col("n") / busiest).join(rate, "tick")
    load = F.least(F.lit(1.0), 0.7 * F.col("ops_load") + 0.3 * F.col("size") / max(1, capacity // SEGMENTS))
    latency = F.when(F.col("n") > 0, 0.2 + 0.8 * F.col("ops_load")).otherwise(0.1)
    return out.select("tick", "shard", load.alias("load"), "hit_rate", latency.alias("latency_ms"))


def deltas(counters: DataFrame) -> DataFrame:
    """Growth of cumulative counters (tick, shard, total) since the tick before."""
    w = Window.partitionBy("shard").orderBy("tick")
    return counters.withColumn("ops", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0).cast("long")))


def ring(rows: DataFrame, order: str = "seq", keep: int = TELEMETRY_RING) -> DataFrame:
    """The newest ``keep`` rows; a top-k, so no full sort."""
    return rows.orderBy(F.desc(order)).limit(keep)


def training_batch(telemetry_rows: DataFrame, keep: int = TRAIN_BATCH, least: int = TRAIN_MINIMUM) -> DataFrame:
    """x (shard share), t and load of the newest records; none if under ``least``."""
    newest = ring(telemetry_rows, "seq", keep)
    n = newest.agg(F.count(F.lit(1)).alias("_n"))
    return newest.join(F.broadcast(n)).where(F.col("_n") >= least).select("seq", (F.col("shard") / SEGMENTS).alias("x"), "t", "load")


def hours_since(ts: Column, start: Column) -> Column:
    """Whole seconds since the start, in hours."""
    return (F.unix_seconds(ts) - F.unix_seconds(start)) / 3600.0


def blend(predictions: DataFrame, counts: DataFrame) -> DataFrame:
    """Three tenths of the prediction and seven of the measured share."""
    top = counts.agg(F.greatest(F.max("ops"), F.lit(1)).alias("_m"))
    return predictions.join(counts, "shard").join(F.broadcast(top)).select("shard", (0.3 * F.col("prediction") + 0.7 * F.col("ops") / F.col("_m")).alias("load"))


def recommendations(loads: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each shard over ``threshold`` a move to the least loaded one, the first
    of several, if that is below the mean."""
    stats = loads.agg(F.min(F.struct("load", "shard")).alias("low"), F.avg("load").alias("mean"))
    hot = loads.where(F.col("load") > threshold).join(F.broadcast(stats)).where(F.col("low.load") < F.col("mean"))
    gap = F.col("load") - F.col("low.load")
    return hot.select(F.col("shard").alias("from_shard"), F.col("low.shard").alias("to_shard"), F.col("load").alias("from_load"), F.col("low.load").alias("to_load"), F.least(F.lit(1.0), gap / threshold).alias("confidence"))


def event_ring(events: DataFrame) -> DataFrame:
    return ring(events, "seq", EVENT_RING)


def leader_changes(observed: DataFrame, bucket: int = 65_536) -> DataFrame:
    """Observations (seq, leader) whose leader differs from the one before.

    Buckets of the sequence are compared inside; each bucket's first row is
    compared with the last of the bucket before.
    """
    b = observed.withColumn("_b", F.floor(F.col("seq") / bucket).cast("long"))
    inside = Window.partitionBy("_b").orderBy("seq")
    last = b.groupBy("_b").agg(F.max_by("leader", "seq").alias("_last"))
    before = last.select(F.col("_b"), F.lag("_last").over(Window.orderBy("_b")).alias("_before"))
    prior = F.coalesce(F.lag("leader").over(inside), F.col("_before"))
    return b.join(before, "_b").withColumn("previous", prior).where(F.col("previous").isNotNull() & (F.col("previous") != F.col("leader"))).select("seq", "previous", "leader")


def rate_split(rates: DataFrame, workers: int = 4) -> DataFrame:
    """The clamped rate, each worker's share and its batch every tenth of a second."""
    rate = F.greatest(F.lit(0), F.least(F.lit(MAX_RATE), F.col("rate")))
    share = F.greatest(F.lit(1), F.floor(rate / workers).cast("int"))
    return rates.select(F.col("rate").alias("asked"), rate.alias("rate"), share.alias("worker_rate"), F.greatest(F.lit(1), F.floor(share * 100 / 1000).cast("int")).alias("batch"))
