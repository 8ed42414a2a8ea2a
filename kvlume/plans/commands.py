"""The command language over tokens, and the HTTP API as functions of its bodies.

``replies`` answers a session's commands in order.  The cache tier decides what
EXISTS, KEYS and DBSIZE see; DEL counts its arguments; KEYS takes any pattern;
FLUSHALL empties the cache and keeps the backend.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlume.functions import resp
from kvlume.schemas import MAX_RATE, SEGMENTS

VERSION = "1.0.0"


def verb(tokens: Column) -> Column:
    return F.upper(F.get(tokens, F.lit(0)))


def set_value(tokens: Column) -> Column:
    """All tokens after the key, joined by single spaces."""
    return F.array_join(F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(1))), " ")


def to_log(commands: DataFrame) -> DataFrame:
    """Commands (seq, tokens) as writes and reads of the key-value log; a DEL of
    several keys gives a row for each."""
    v = verb(F.col("tokens"))
    n = F.size("tokens")
    op = F.when((v == "SET") & (n >= 3), "PUT").when((v == "DEL") & (n >= 2), "DEL").when((v == "GET") & (n == 2), "GET")
    keys = F.when(v == "DEL", F.slice("tokens", 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.slice("tokens", 2, 1))
    rows = commands.select("seq", op.alias("op"), F.posexplode(keys).alias("part", "key"), F.when(v == "SET", set_value(F.col("tokens"))).alias("value"))
    return rows.where(F.col("op").isNotNull())


def stateless_reply(tokens: Column, lookup: Column) -> Column:
    """Replies that need no state but the value ``lookup`` that GET finds."""
    v, n = verb(tokens), F.size(tokens)
    wrong = lambda name: resp.error(F.lit(f"wrong number of arguments for '{name}'"))
    ok = resp.simple_string(F.lit("OK"))
    arg = F.get(tokens, F.lit(1))
    return (
        F.when(n == 0, resp.error(F.lit("empty command")))
        .when(v == "GET", F.when(n < 2, wrong("GET")).otherwise(F.coalesce(resp.bulk_string(lookup), resp.null())))
        .when(v == "SET", F.when(n < 3, wrong("SET")).otherwise(ok))
        .when(v == "DEL", F.when(n < 2, wrong("DEL")).otherwise(resp.integer(n - 1)))
        .when(v == "PING", F.when(n > 1, resp.bulk_string(arg)).otherwise(resp.simple_string(F.lit("PONG"))))
        .when(v.isin("FLUSHALL", "FLUSHDB", "QUIT", "COMMAND", "CLIENT"), ok)
        .when((v == "CONFIG") & (n >= 3) & (F.upper(arg) == "GET"), resp.array(F.array(F.get(tokens, F.lit(2)), F.lit(""))))
        .when(v == "CONFIG", ok)
        .otherwise(resp.error(F.concat(F.lit("unknown command '"), F.get(tokens, F.lit(0)), F.lit("'"))))
    )


def info(stats: DataFrame) -> DataFrame:
    """The INFO text from counters: cache_hits, cache_misses, write_through_ops,
    write_back_ops, keys and write_mode."""
    line = lambda name: F.concat(F.lit(f"{name}:"), F.col(name).cast("string"))
    parts = [F.lit("# Server"), F.lit(f"distributed_cache_version:{VERSION}"), line("write_mode"), F.lit(""), F.lit("# Stats"), *[line(c) for c in ("cache_hits", "cache_misses", "write_through_ops", "write_back_ops")], F.lit(""), F.lit("# Keyspace"), line("keys"), F.lit("")]
    return stats.select(F.array_join(F.array(*parts), "\r\n").alias("info"))


class Session:
    """One session's cache and backend, replayed command by command."""

    def __init__(self, capacity: int = 65_536, mode: str = "write-through", backend: dict | None = None):
        from kvlume.operators.residency import Lru

        self.cache, self.backend, self.mode = Lru(capacity), dict(backend or {}), mode
        self.hits = self.misses = self.writes = 0

    def _spill(self):
        for key, (value, dirty) in self.cache.evicted:
            if dirty:
                self.backend[key] = value
        self.cache.evicted.clear()

    def run(self, tokens: list[str]) -> tuple[str, bool]:
        """The reply, and whether the connection closes."""
        crlf = "\r\n"
        bulk = lambda s: f"${len(s.encode())}{crlf}{s}{crlf}"
        err = lambda s: f"-ERR {s}{crlf}"
        ok, n = f"+OK{crlf}", len(tokens)
        if not n:
            return err("empty command"), False
        v = tokens[0].upper()
        need = {"GET": 2, "SET": 3, "DEL": 2, "EXISTS": 2}
        if n < need.get(v, 0):
            return err(f"wrong number of arguments for '{v}'"), False
        if v == "GET":
            row = self.cache.get(tokens[1])
            if row is not None:
                self.hits += 1
                return bulk(row[0]), False
            self.misses += 1
            if tokens[1] not in self.backend:
                return f"$-1{crlf}", False
            self.cache.put(tokens[1], self.backend[tokens[1]], dirty=False)
            self._spill()
            return bulk(self.backend[tokens[1]]), False
        if v == "SET":
            value = " ".join(tokens[2:])
            through = self.mode == "write-through"
            self.cache.put(tokens[1], value, dirty=not through)
            self._spill()
            if through:
                self.backend[tokens[1]] = value
            self.writes += 1
            return ok, False
        if v == "DEL":
            for key in tokens[1:]:
                self.cache.rows.pop(key, None)
                self.backend.pop(key, None)
            return f":{n - 1}{crlf}", False
        if v == "EXISTS":
            return f":{int(tokens[1] in self.cache.rows)}{crlf}", False
        if v == "KEYS":
            return f"*{len(self.cache.rows)}{crlf}" + "".join(map(bulk, self.cache.rows)), False
        if v == "DBSIZE":
            return f":{len(self.cache.rows)}{crlf}", False
        if v in ("FLUSHALL", "FLUSHDB"):
            self.cache.clear()
            self._spill()
            return ok, False
        if v == "PING":
            return (bulk(tokens[1]) if n > 1 else f"+PONG{crlf}"), False
        if v == "INFO":
            through = self.mode == "write-through"
            text = crlf.join(["# Server", f"distributed_cache_version:{VERSION}", f"write_mode:{self.mode}", "", "# Stats", f"cache_hits:{self.hits}", f"cache_misses:{self.misses}", f"write_through_ops:{self.writes if through else 0}", f"write_back_ops:{0 if through else self.writes}", "", "# Keyspace", f"keys:{len(self.cache.rows)}", ""])
            return bulk(text), False
        if v == "CONFIG" and n >= 3 and tokens[1].upper() == "GET":
            return f"*2{crlf}{bulk(tokens[2])}{bulk('')}", False
        if v in ("COMMAND", "CLIENT", "CONFIG", "QUIT"):
            return ok, v == "QUIT"
        return err(f"unknown command '{tokens[0]}'"), False


def replies(commands: DataFrame, capacity: int = 65_536, mode: str = "write-through") -> DataFrame:
    """``session``, ``seq``, ``reply`` and ``close`` for commands (session, seq,
    tokens). Sessions are independent and run in parallel; within one, order is
    all that matters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = Session(capacity, mode), []
        for r in pdf.sort_values("seq").itertuples():
            out.append((r.session, r.seq, *s.run(list(r.tokens))))
        return pd.DataFrame(out, columns=["session", "seq", "reply", "close"])

    return commands.groupBy("session").applyInPandas(run, "session string, seq long, reply string, close boolean")


def _leading_int(s: Column) -> Column:
    """What C's atoi reads: a leading number, else 0."""
    return F.coalesce(F.regexp_extract(s, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0))


def traffic_rate(body: Column) -> Column:
    """The clamped rate of ``{"rate": n}``."""
    return F.greatest(F.lit(0), F.least(F.lit(MAX_RATE), _leading_int(F.regexp_extract(body, r'"rate"[^:]*:([\s\S]*)', 1))))


def burst_shards(body: Column) -> Column:
    """Valid shards of ``{"shards": [...]}``; the first four if there are none."""
    inner = F.regexp_extract(body, r"\[([^\]]*)\]", 1)
    named = F.filter(F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), _leading_int), lambda s: (s >= 0) & (s < SEGMENTS))
    return F.when(F.size(named) > 0, named).otherwise(F.array(*[F.lit(i) for i in range(4)]))


def burst_intensity(body: Column) -> Column:
    asked = F.when(F.instr(body, '"intensity"') > 0, _leading_int(F.regexp_extract(body, r'"intensity"[^:]*:([\s\S]*)', 1))).otherwise(500)
    return F.greatest(F.lit(50), F.least(F.lit(5000), asked))


# File name endings and their types.
MIME_TYPES = {".html": "text/html", ".css": "text/css", ".js": "application/javascript", ".json": "application/json", ".png": "image/png", ".svg": "image/svg+xml", ".ico": "image/x-icon"}
ROUTES = ("/metrics", "/api/metrics", "/api/start", "/api/stop", "/api/reset", "/api/traffic", "/api/burst", "/api/burst-stop", "/api/flush", "/api/compact", "/api/election")


def content_type(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for ending, kind in MIME_TYPES.items():
        out = out.when(F.endswith(path, F.lit(ending)), kind)
    return out.otherwise("text/plain")


def dispatch(method: Column, target: Column) -> Column:
    """What a request line leads to: preflight, refused, api or file."""
    path = F.substring_index(target, "?", 1)
    return F.when(F.upper(method) == "OPTIONS", "preflight").when(path.isin(*ROUTES), "api").when(F.contains(path, F.lit("..")), "refused").otherwise("file")
