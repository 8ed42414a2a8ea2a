"""The wire protocol and the command language by the fixtures' cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvlume.functions import resp
from kvlume.plans import commands
from kvlume.plans.commands import Session

CR = "\r\n"


@pytest.mark.parametrize(
    ("wire", "tokens", "used"),
    [
        (b"SET name Gemini\r\n", ["SET", "name", "Gemini"], 17),
        (b"GET name\r\n", ["GET", "name"], 10),
        (b"*3\r\n$3\r\nSET\r\n$4\r\nname\r\n$6\r\nGemini\r\n", ["SET", "name", "Gemini"], 35),
        (b"*2\r\n$3\r\nGET\r\n$4\r\nname\r\n", ["GET", "name"], 23),
        (b"*2\r\n$3\r\nGET\r\n$4\r\nna", [], 0),
        (b"*1\r\n$-1\r\n", [""], 9),
        (b"*1\r\n:42\r\n", ["42"], 9),
        (b"PING\n", ["PING"], 5),
        (b"PING", ["PING"], 4),
        (b"", [], 0),
    ],
)
def test_parse(wire, tokens, used):
    assert resp.parse_one(wire) == (tokens, used, None)


def test_bad_length_is_an_error():
    assert resp.parse_one(b"*x\r\n")[2]


def test_pipelined():
    assert [t for t, _, _ in resp.parse_all(b"PING\r\n*1\r\n$4\r\nQUIT\r\nGET a")] == [["PING"], ["QUIT"], ["GET", "a"]]


def test_encode(spark):
    row = spark.range(1).select(resp.simple_string(F.lit("OK")), resp.error(F.lit("bad key")), resp.integer(F.lit(42)), resp.bulk_string(F.lit("hello")), resp.null(), resp.array(F.array(F.lit("a"), F.lit("b"))), resp.bulk_string(F.lit("é"))).first()
    assert tuple(row) == ("+OK\r\n", "-ERR bad key\r\n", ":42\r\n", "$5\r\nhello\r\n", "$-1\r\n", "*2\r\n$1\r\na\r\n$1\r\nb\r\n", "$2\r\né\r\n")


SESSION = [
    ("PING", "+PONG"), ("PING hello", "$5|hello"), ("SET name Alice", "+OK"), ("GET name", "$5|Alice"), ("SET city NewYork", "+OK"), ("GET city", "$7|NewYork"), ("GET nonexistent", "$-1"),
    ("set name Bob", "+OK"), ("get name", "$3|Bob"), ("EXISTS name", ":1"), ("EXISTS ghost", ":0"), ("DEL city", ":1"), ("GET city", "$-1"), ("DEL ghost", ":1"), ("DEL a b c", ":3"),
    ("SET k a  b", "+OK"), ("GET k", "$3|a b"), ("DBSIZE", ":2"), ("KEYS x*", "*2|$4|name|$1|k"), ("FLUSHALL", "+OK"), ("DBSIZE", ":0"), ("GET name", "$3|Bob"), ("DBSIZE", ":1"),
    ("BADCMD", "-ERR unknown command 'BADCMD'"), ("GET", "-ERR wrong number of arguments for 'GET'"), ("CONFIG GET save", "*2|$4|save|$0|"), ("COMMAND", "+OK"), ("", "-ERR empty command"), ("QUIT", "+OK"),
]


def test_session(spark):
    rows = [("s", i, line.split()) for i, (line, _) in enumerate(SESSION)]
    got = commands.replies(spark.createDataFrame(rows, "session string, seq long, tokens array<string>")).orderBy("seq").collect()
    assert [r["reply"] for r in got] == [want.replace("|", CR) + CR for _, want in SESSION]
    assert [r["close"] for r in got] == [False] * (len(SESSION) - 1) + [True]


def test_info_and_write_back():
    s = Session(capacity=2, mode="write-back")
    for line in ("SET a 1", "SET b 2", "GET a", "GET zz"):
        s.run(line.split())
    assert s.backend == {}
    s.run(["SET", "c", "3"])  # throws b out, which is dirty
    assert s.backend == {"b": "2"}
    text = s.run(["INFO"])[0]
    for part in ("distributed_cache_version:1.0.0", "write_mode:write-back", "cache_hits:1", "cache_misses:1", "write_back_ops:3", "keys:2"):
        assert part in text


@pytest.mark.parametrize(("body", "rate"), [('{"rate": 100}', 100), ('{"rate": -5}', 0), ('{"rate":99999}', 12000), ("{}", 0), ('{"rate": x}', 0)])
def test_rate(spark, body, rate):
    assert spark.range(1).select(commands.traffic_rate(F.lit(body))).first()[0] == rate


@pytest.mark.parametrize(("body", "shards", "intensity"), [('{"shards":[0,1,40], "intensity": 60}', [0, 1], 60), ("{}", [0, 1, 2, 3], 500), ('{"shards":[x], "intensity": 9}', [0], 50), ('{"intensity": 9999}', [0, 1, 2, 3], 5000)])
def test_burst(spark, body, shards, intensity):
    row = spark.range(1).select(commands.burst_shards(F.lit(body)), commands.burst_intensity(F.lit(body))).first()
    assert (row[0], row[1]) == (shards, intensity)
