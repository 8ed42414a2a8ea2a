"""Streams drained to the end, and the load model."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlume.functions.hashing import segment_of
from kvlume.operators import loadstats, model, policy, quorum, residency, versions
from kvlume.schemas import Config, parse_args
from kvlume.sources.backend import LogBackend
from kvlume.streaming import flows


def _log(spark, n=400):
    r = random.Random(5)
    rows = [(i, f"k{r.randrange(30)}", r.choices(["PUT", "GET", "DEL"], [6, 3, 1])[0], f"v{i}") for i in range(n)]
    return spark.createDataFrame(rows, flows.LOG)


def test_write_back_stream(spark, tmp_path):
    log = _log(spark)
    src = str(tmp_path / "src")
    for lo in (0, 150, 300):
        log.where((F.col("seq") >= lo) & (F.col("seq") < lo + 150)).coalesce(1).write.mode("append").parquet(src)
    b = LogBackend(spark, str(tmp_path / "backend"))
    for run in ("a", "b"):  # the second run replays everything
        flows.write_back(flows.read_log(spark, src, 1), b, str(tmp_path / f"ck{run}"), every=None).awaitTermination()
        want = {r["key"]: r["value"] for r in versions.latest(log).collect()}
        assert {r["key"]: r["value"] for r in b.latest().collect()} == want


def test_lru_stream_equals_fold(spark, tmp_path):
    log = _log(spark).withColumn("segment", segment_of(F.col("key"), 2))
    src = str(tmp_path / "src")
    for lo in (0, 150, 300):
        log.where((F.col("seq") >= lo) & (F.col("seq") < lo + 150)).coalesce(1).write.mode("append").parquet(src)
        import time

        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(flows.LOG + ", segment int").option("maxFilesPerTrigger", 1).parquet(src)
    got = {}
    flows.drain(flows.lru(stream, 5), lambda b: got.update({r["seq"]: (r["hit"], r["evicted"]) for r in b.collect()}), str(tmp_path / "ck"))
    want = residency.fold(log.withColumn("value", F.lit(0.0)), 5).collect()
    assert got == {r["seq"]: (r["hit"], r["evicted"]) for r in want}


def test_windowed_load(spark, tmp_path, sf):
    from kvlume.sources.tables import kv_log

    kv_log(spark, sf).repartition(1).write.parquet(str(tmp_path / "kv"))
    stream = spark.readStream.schema(kv_log(spark, sf).schema).parquet(str(tmp_path / "kv"))
    total = []
    flows.drain(flows.segment_load(stream, "1 day"), lambda b: total.append(b.agg(F.sum("ops")).first()[0] or 0), str(tmp_path / "ck"), "update")
    assert sum(total) == kv_log(spark, sf).count()


def test_network_learns():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 32, 64) / 32, np.full(64, 0.5)])
    y = 0.5 + 0.3 * np.sin(6 * x[:, 0])
    net = model.Network(seed=1)
    losses = [net.train_step(x, y) and net.data_loss for _ in range(300)]
    assert losses[-1] < 0.2 * losses[0] and net.steps == 300
    assert net.total_loss == pytest.approx(net.data_loss + 0.1 * net.pde_loss)
    assert net.predict_loads(0.5).min() >= 0 and len(net.predict_loads(0.5)) == 32


def test_parameters_and_gradient():
    assert model.parameters() == 12_737
    net = model.Network((2, 3, 1), seed=3)
    x, y = np.array([[0.1, 0.2], [0.4, 0.3]]), np.array([1.0, 0.0])
    a = net.activations(x)
    grad = 2 * (a[-1] - y[:, None]) / 2
    analytic = a[-2].T @ grad
    h = 1e-6
    loss = lambda: np.mean((net.forward(x) - y) ** 2)
    net.w[-1][1, 0] += h
    up = loss()
    net.w[-1][1, 0] -= 2 * h
    assert (up - loss()) / (2 * h) == pytest.approx(analytic[1, 0], abs=1e-5)
    assert model.sgd(np.ones(2), np.ones(2), 0.5).tolist() == [0.5, 0.5]


def test_adam_first_step():
    step = model.Adam(2).step(np.array([1.0, -4.0]))
    assert step == pytest.approx([-1e-3, 1e-3])


def test_training_needs_eight_rows(spark):
    rows = spark.createDataFrame([(i, i, 0.1, 0.5) for i in range(7)], "seq long, shard int, t double, load double")
    assert loadstats.training_batch(rows).count() == 0
    assert model.fit(loadstats.training_batch(rows)).steps == 0
    more = rows.unionByName(rows.withColumn("seq", F.col("seq") + 7))
    assert loadstats.training_batch(more).count() == 14


def test_peak_and_recommendation_ties(spark):
    loads = spark.createDataFrame([(0, 0.0), (1, 0.9), (2, 0.9), (3, 0.0)], "shard int, load double")
    assert loadstats.peak_shard(loads).first()["shard"] == 1
    assert {(r["from_shard"], r["to_shard"]) for r in loadstats.recommendations(loads).collect()} == {(1, 0), (2, 0)}
    assert tuple(loadstats.peak_shard(loads.where("load < 0")).first()) == (0, 0.0)


def test_cooldown(spark):
    w = spark.createDataFrame([(i, 100, 2, True, False) for i in range(25)], "window long, total long, hot long, burst boolean, heat_stroke boolean")
    assert [r["window"] for r in loadstats.with_cooldown(w).where("reported").orderBy("window").collect()] == [0, 11, 22]


def test_votes(spark):
    voters = spark.createDataFrame([(0, 5, None, 10, 4), (1, 5, 2, 10, 4), (2, 6, None, 9, 5), (3, 9, None, 1, 1)], "node_id int, current_term long, voted_for int, last_index long, last_term long")
    cand = spark.createDataFrame([(4, 6, 10, 4)], "candidate int, term long, last_index long, last_term long")
    got = {r["node_id"]: r["granted"] for r in quorum.grant_votes(cand, voters).collect()}
    # node 2 has a later log, node 3 a later term; node 1's vote was for an older term
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_apply_commands(spark):
    log = spark.createDataFrame([(1, 1, "PUT a some value"), (1, 2, " DEL  b "), (1, 3, "NOOP x"), (1, 4, "PUT c"), (1, 5, "PUT a z\n2")], "term long, index long, command string")
    assert [(r["seq"], r["op"], r["key"], r["value"]) for r in quorum.apply(log).orderBy("seq").collect()] == [(1, "PUT", "a", "some value"), (2, "DEL", "b", None), (4, "PUT", "c", ""), (5, "PUT", "a", "z\n2")]


def test_clear_dirty_race(spark):
    state = spark.createDataFrame([("a", 5, True), ("b", 6, True), ("c", 7, True)], "key string, seq long, dirty boolean")
    flushed = spark.createDataFrame([("a", 5), ("b", 4)], "key string, seq long")
    assert {r["key"]: r["dirty"] for r in policy.clear_dirty(state, flushed).collect()} == {"a": False, "b": True, "c": True}


def test_config():
    assert parse_args([]) == Config()
    c = parse_args(["--capacity", "100", "--mode", "write-back"])
    assert c.segment_capacity == 3 and c.mode == "write-back" and c.cluster_size == 5


def test_cooldown_equals_a_plain_loop(spark):
    import random

    r = random.Random(8)
    rows = [(i, r.choice([20, 60, 100]), 3, False, False) for i in range(300)]
    rows = [(i, t, h, t > 50 and r.random() < (0.6 if i // 40 % 2 else 0.04), False) for i, t, h, _, _ in rows]
    mute, want = 0, []
    for i, total, _, burst, _ in rows:
        if total > 50:
            if mute:
                mute -= 1
            elif burst:
                mute = 10
                want.append(i)
    w = spark.createDataFrame(rows, "window long, total long, hot long, burst boolean, heat_stroke boolean")
    got = loadstats.with_cooldown(w)
    assert got.count() == 300 and [x["window"] for x in got.where("reported").orderBy("window").collect()] == want
