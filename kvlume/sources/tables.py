"""Operation logs and fixtures derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlume.functions.hashing import segment_of
from kvlume.functions.prefix import rank
from kvlume.schemas import NODES, SEGMENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """Tasks that take a table's rows in shares of about ``rows``, no fewer than
    there are cores and no more than the 200 up to which Spark writes a shuffle
    without holding a task's input in memory; larger tables get larger shares.
    The rows are counted in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, min(200, 1 + table(spark, sf_dir, name).count() // rows))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, key, op, value, segment: the events as keyed operations."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "PUT").when(kind == "error", "DEL").otherwise("GET")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), op.alias("op"), "value")
    return log.withColumn("segment", segment_of(F.col("key")))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, segment: part accesses by line item, in the order of the items;
    there are no deletes. Ranges of order keys are so narrow that tasks get about
    equal shares."""
    ties = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = rank(table(spark, sf_dir, "lineitem").select("l_orderkey", *ties), "l_orderkey", "seq", 8_192, ties=ties, parts=parts(spark, sf_dir, "lineitem"))
    return items.select("seq", F.concat(F.lit("part:"), F.col("l_partkey")).alias("key")).withColumn("segment", segment_of(F.col("key")))


def traffic(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """kn, op, key, shard, node: the synthetic load, one row per operation.

    A tenth of the operations each goes to two hot shards. The shard is a label
    of the generator, not the segment that the key hashes to.
    """
    kn = F.col("kn")
    roll = kn % 100
    shard = F.when(roll < 10, 4).when(roll < 20, 5).otherwise(kn % SEGMENTS).cast("int")
    key = F.when(roll < 10, F.concat(F.lit("hot4_"), kn % 5000)).when(roll < 20, F.concat(F.lit("hot5_"), kn % 5000)).otherwise(F.concat(F.lit("k"), kn % 50_000))
    ops = spark.range(n).withColumnRenamed("id", "kn")
    return ops.select("kn", F.when(kn % 7 <= 2, "SET").otherwise("GET").alias("op"), key.alias("key"), shard.alias("shard"), F.floor(shard * NODES / SEGMENTS).cast("int").alias("node"))


def burst_load(spark: SparkSession, rounds: int, shards: list[int]) -> DataFrame:
    """The writes of a persistent burst: each round puts one key per shard."""
    ops = spark.range(rounds).select(F.col("id").alias("round"), F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard"))
    return ops.select("round", "shard", F.concat(F.lit("burst_s"), F.col("shard"), F.lit("_"), F.col("round")).alias("key"))


def raft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, term, index, command: the orders as a log on five nodes. Node 3
    diverges in its last tenth, node 4 has only the first six tenths."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("index"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("DEL cust:"), F.col("o_custkey"))).otherwise(F.concat(F.lit("PUT cust:"), F.col("o_custkey"), F.lit(" "), F.col("o_orderpriority"))).alias("command"))
    last = orders.agg(F.max("index").alias("n"))
    nodes = orders.crossJoin(F.broadcast(last)).withColumn("node_id", F.explode(F.array(*[F.lit(i) for i in range(NODES)])))
    diverges = (F.col("node_id") == 3) & (F.col("index") * 10 > F.col("n") * 9)
    kept = nodes.where((F.col("node_id") != 4) | (F.col("index") * 10 <= F.col("n") * 6))
    return kept.select("node_id", (F.floor((F.col("index") - 1) / 1000) + 1 + F.when(diverges, 100).otherwise(0)).alias("term"), "index", "command")
