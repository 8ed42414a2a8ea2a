"""Files: round trips, damaged input, and what a later write does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvlume.operators import bloom, compaction, versions
from kvlume.sources import binary, flatfile
from kvlume.sources.backend import LogBackend


def test_flat_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tv\nno tab here\nk2\ta\tb\nk\tnew\n\tempty key\n")
    got = {r["key"]: r["value"] for r in flatfile.load(spark, str(tmp_path / "a.txt")).collect()}
    assert got == {"k": "new", "k2": "a\tb", "": "empty key"}
    batch = spark.createDataFrame([("k", "x", 1), ("n", "1", 2), ("n", "2", 3)], "key string, value string, seq long")
    flatfile.merge(spark, str(tmp_path / "a.txt"), batch, str(tmp_path / "b"))
    got = {r["key"]: r["value"] for r in flatfile.load(spark, str(tmp_path / "b")).collect()}
    assert got == {"k": "x", "k2": "a\tb", "": "empty key", "n": "2"}
    flatfile.remove(spark, str(tmp_path / "b"), spark.createDataFrame([("k",), ("zz",)], "key string"), str(tmp_path / "c"))
    assert flatfile.load(spark, str(tmp_path / "c")).count() == 3


@pytest.mark.parametrize(("key", "value"), [("a\tb", "v"), ("a", "v\nw"), (None, "v")])
def test_flat_file_refuses(spark, tmp_path, key, value):
    with pytest.raises(Exception, match="flat file"):
        flatfile.store(spark.createDataFrame([(key, value)], "key string, value string"), str(tmp_path / "x"))


def test_wal(spark, tmp_path):
    rows = [("PUT", i, f"k{i}".encode(), b"\x00\xff" * i) for i in range(5)] + [("DEL", 5, b"k1", b"")]
    data = b"".join(binary.encode_frame(*r) for r in rows)
    assert len(data) == sum(25 + len(r[2]) + len(r[3]) for r in rows)
    (tmp_path / "good.wal").write_bytes(data)
    broken = bytearray(data)
    broken[len(binary.encode_frame(*rows[0])) + 12] ^= 1
    (tmp_path / "broken.wal").write_bytes(bytes(broken))
    (tmp_path / "short.wal").write_bytes(data[:-3])
    (tmp_path / "empty.wal").write_bytes(b"")
    got = binary.read_wal(spark, str(tmp_path))
    n = {r[0].rsplit("/", 1)[1]: r[1] for r in got.groupBy("file").count().collect()}
    assert n == {"good.wal": 6, "broken.wal": 1, "short.wal": 5}
    log = got.where(F.col("file").endswith("good.wal")).select("seq", F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"))
    assert versions.latest(log.unionByName(log)).count() == 4  # replayed twice
    assert versions.next_sequence(log).first()["next_seq"] == 6


def test_sorted_table(spark, tmp_path):
    rows = {f"k{i:03}".encode(): f"v{i}".encode() for i in range(300)}
    data = binary.encode_table(rows)
    (tmp_path / "1.sst").write_bytes(data)
    (tmp_path / "2.sst").write_bytes(data[:-1])
    (tmp_path / "3.sst").write_bytes(b"tiny")
    got = [(bytes(r["key"]), bytes(r["value"])) for r in binary.read_tables(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(rows.items())
    place = binary.decode_footer(data)
    b = binary.Bloom.decode(data[place[2] : place[2] + place[3]])
    assert all(b.may_contain(k) for k in rows) and sum(b.may_contain(f"no{i}".encode()) for i in range(1000)) < 30


def test_raft_entries(spark, tmp_path):
    data = binary.encode_entries([(1, 1, b"PUT a b"), (2, 2, b"DEL a")])
    (tmp_path / "raft_log.dat").write_bytes(data + b"\x01\x02")
    got = binary.read_raft(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["term"], r["index"], bytes(r["command"])) for r in got] == [(1, 1, b"PUT a b"), (2, 2, b"DEL a")]


def test_checksum():
    assert binary.checksum(b"") == 0 and binary.checksum(b"a") == (0x61 * 0x01000193) & 0xFFFFFFFF


def test_backend(spark, tmp_path):
    b = LogBackend(spark, str(tmp_path / "log"))
    assert not b.ping() and b.size() == 0
    b.batch_store(spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "key string, value string, seq long"))
    b.remove(spark.createDataFrame([("b", 4)], "key string, seq long"))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    want = {"a": ("3", True), "b": (None, False), "c": (None, False)}
    assert {r["key"]: (r["value"], r["found"]) for r in b.load(keys).collect()} == want
    b.compact()
    assert {r["key"]: (r["value"], r["found"]) for r in b.load(keys).collect()} == want and b.size() == 1


def test_columns_equal_the_python_rules(spark):
    from kvlume.functions import hashing
    from kvlume.schemas import segment_capacity

    rows = spark.range(1, 3000, 7).select("id", bloom.bits_of(F.col("id")).alias("bits"), hashing.capacity_of(F.col("id")).alias("share")).collect()
    assert all(r["bits"] == bloom.sizing(r["id"])[0] and r["share"] == segment_capacity(r["id"]) for r in rows)


def test_running_sums_keep_null_orders(spark):
    from kvlume.functions.prefix import rank, running_sum

    df = spark.createDataFrame([(None, 5, None), (3, 1, "a"), (200_000, 2, None), (1, 4, "a")], "seq long, v long, k string")
    got = {(r["seq"], r["s"]) for r in running_sum(df, "seq", F.col("v"), "s").collect()}
    assert got == {(None, 5), (1, 9), (3, 10), (200_000, 12)}
    assert {(r["k"], r["seq"], r["n"]) for r in rank(df, "seq", "n", keys=("k",)).collect()} == {(None, None, 1), (None, 200_000, 2), ("a", 1, 1), ("a", 3, 2)}


def test_files_of_odd_rows(spark, tmp_path):
    """Empty keys and values, zero bytes, several files a run."""
    rows = [(1, "PUT", "", ""), (2, "DEL", "k", None), (3, "PUT", "k\0", "v\0\0"), (1 << 40, "PUT", "é\n", "\r\n")]
    binary.write_wal(spark.createDataFrame(rows, "seq long, op string, key string, value string"), str(tmp_path / "w"))
    got = sorted((r["seq"], r["op"], bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in binary.read_wal(spark, str(tmp_path / "w"), "*.txt").collect())
    assert got == [(a, b, c, d or "") for a, b, c, d in rows]
    runs = spark.range(500).selectExpr("int(id % 2) level", "id % 3 sst_id", "concat('k', id, char(0)) key", "concat(id, char(0)) value")
    binary.write_tables(runs, str(tmp_path / "t"))
    back = binary.read_tables(spark, str(tmp_path / "t"), "*.txt").selectExpr("cast(key as string) key", "cast(value as string) value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, runs.select("key", "value").collect()))
    found = binary.lookup(spark, str(tmp_path / "t"), ["k7\0", "k499\0", "nope", ""], "*.txt").collect()
    assert sorted(bytes(r["value"]) for r in found) == [b"499\0", b"7\0"]
    binary.write_state(spark.createDataFrame([(0, 7, None), (1, 9, 3)], "node_id int, current_term long, voted_for int"), str(tmp_path / "s"))
    assert sorted((r["current_term"], r["voted_for"]) for r in binary.read_state(spark, str(tmp_path / "s"), "*.txt").collect()) == [(7, None), (9, 3)]
    with pytest.raises(Exception, match="exists"):
        binary.write_wal(spark.createDataFrame(rows, "seq long, op string, key string, value string"), str(tmp_path / "w"))


def test_bloom_sizing():
    assert bloom.sizing(1) == (64, 6) and bloom.sizing(1001) == (10016, 6) and bloom.sizing(10, 0.5)[1] == 1


def test_runs_round_trip_and_pruning(spark, tmp_path):
    log = spark.createDataFrame([(i, f"k{i % 7}", "DEL" if i % 5 == 0 else "PUT", float(i)) for i in range(60)], "seq long, key string, op string, value double")
    runs = compaction.flush(compaction.epochs(log, 400))
    path = str(tmp_path / "runs")
    compaction.write_runs(runs, path)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(runs.columns).collect())) == sorted(map(str, runs.collect()))
    plan = back.where((F.col("level") == 0) & (F.col("key") == "k1"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "EqualTo(key,k1)" in plan
    merged = compaction.compact(back, 99)
    want = {r["key"]: (r["op"], r["value"]) for r in versions.newest(log).collect()}
    assert {r["key"]: (r["op"], r["value"]) for r in merged.collect()} == want
    twice = compaction.compact(merged.unionByName(back.select(merged.columns)), 100)
    assert {r["key"]: (r["op"], r["value"]) for r in twice.collect()} == want
