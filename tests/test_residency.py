"""LRU rules by the fixtures' cases and against a simulator of its own."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kvlume.functions.hashing import segment_of
from kvlume.functions.prefix import rank
from kvlume.operators import residency
from kvlume.operators.residency import Lru
from kvlume.schemas import segment_capacity
from kvlume.sources import tables


class Plain:
    """A list from oldest to newest; written apart from the library's cache."""

    def __init__(self, capacity):
        self.capacity, self.order, self.gone = capacity, [], []

    def touch(self, key):
        self.order.remove(key)
        self.order.append(key)

    def access(self, op, key):
        hit = key in self.order
        if op == "DEL":
            if hit:
                self.order.remove(key)
                self.gone.append(key)
        elif hit:
            self.touch(key)
        elif op == "PUT":
            if len(self.order) == self.capacity:
                self.gone.append(self.order.pop(0))
            self.order.append(key)
        return hit


def test_basic_and_update():
    c = Lru(3)
    for k, v in zip("abc", "123", strict=True):
        c.put(k, v)
    assert [c.get(k)[0] for k in "abc"] == ["1", "2", "3"]
    c.put("a", "new")
    assert c.get("a")[0] == "new" and len(c.rows) == 3
    assert c.get("zzz") is None


def test_evict_and_promote():
    c = Lru(3)
    for k in "abc":
        c.put(k, k)
    c.get("a")
    c.put("d", "d")
    assert c.get("b") is None and c.get("a") and c.evicted == [("b", ("b", True))]


def test_delete_fires_the_hook():
    c = Lru(5)
    c.put("x", "1")
    assert c.delete("x") and not c.delete("x") and c.evicted == [("x", ("1", True))] and not c.rows


def test_dirty_and_clear():
    c = Lru(10)
    c.put("a", 1)
    c.put("b", 2)
    c.clear_dirty("a")
    assert [k for k, (_, d) in c.rows.items() if d] == ["b"]
    c.clear()
    assert [k for k, _ in c.evicted] == ["a", "b"]


def test_capacity_one_and_large_value():
    c = Lru(1)
    c.put("a", "1")
    c.put("b", "X" * 100_000)
    assert c.get("a") is None and len(c.get("b")[0]) == 100_000 and len(c.rows) == 1
    with pytest.raises(ValueError):
        Lru(0)


def test_capacity_split():
    assert [segment_capacity(n) for n in (100, 5, 65536)] == [3, 1, 2048]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_simulator(spark, seed):
    r = random.Random(seed)
    ops = [(i, f"k{r.randrange(60)}", r.choices(["PUT", "GET", "DEL"], [5, 3, 2])[0], float(i)) for i in range(1500)]
    log = spark.createDataFrame(ops, "seq long, key string, op string, value double").withColumn("segment", segment_of(F.col("key"), 4))
    got = {x["seq"]: (x["hit"], x["evicted"]) for x in residency.fold(log, 6).collect()}
    caches = {}
    segment = {x["key"]: x["segment"] for x in log.select("key", "segment").distinct().collect()}
    for seq, key, op, _ in ops:
        c = caches.setdefault(segment[key], Plain(6))
        hit = c.access(op, key)
        assert got[seq] == (hit, c.gone.pop() if c.gone else None)


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_chunked_hits_equal_simulator(spark, chunk):
    r = random.Random(chunk)
    ops = [(i, f"k{int(r.paretovariate(0.7)) % 80}") for i in range(2000)]
    log = spark.createDataFrame(ops, "seq long, key string").withColumn("segment", segment_of(F.col("key"), 3))
    got = {x["seq"]: x["hit"] for x in residency.hits(log, 5, chunk, 3).collect()}
    caches, segment = {}, {x["key"]: x["segment"] for x in log.select("key", "segment").distinct().collect()}
    for seq, key in ops:
        assert got[seq] == caches.setdefault(segment[key], Plain(5)).access("PUT", key)


def test_shares_of_a_trace_do_not_grow_with_it(spark):
    """Each task sorts about as many rows at any size, in ranking and in replay."""
    share = F.spark_partition_id().alias("task")
    for n in (20_000, 80_000):
        parts = n // 2_500
        ranked = rank(spark.range(n), "id", "seq", 100, parts=parts)
        assert ranked.where(F.col("seq") != F.col("id") + 1).count() == 0
        log = ranked.select("seq", F.concat(F.lit("k"), F.col("id") * 7 % 501).alias("key")).withColumn("segment", segment_of(F.col("key")))
        for rows in (ranked, residency.hits(log, 5, 500, 3, parts=parts)):
            sizes = [r["count"] for r in rows.select(share).groupBy("task").count().collect()]
            assert sum(sizes) == n and max(sizes) < 2.5 * 2_500


def test_hits_rank_a_trace_once(spark, sf):
    """Summaries and replay read one exchange."""
    got = residency.hits(tables.access_log(spark, sf), 5, 500, 3, parts=9)
    assert len(got.collect()) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Sort \[_b#\d+L ASC NULLS FIRST, l_orderkey", final)) == 1


def test_tasks_for_a_table(spark, sf):
    assert tables.parts(spark, sf, "lineitem", 100) == 61 and tables.parts(spark, sf, "lineitem", 10) == 200
    assert tables.parts(spark, sf, "lineitem") == spark.sparkContext.defaultParallelism


def test_empty_log(spark):
    log = spark.createDataFrame([], "seq long, key string, segment int, op string, value double")
    assert residency.hits(log, 3).count() == residency.fold(log, 3).count() == residency.resident(log, 3).count() == 0
