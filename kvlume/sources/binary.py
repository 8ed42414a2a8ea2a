"""Legacy binary files: log frames, sorted tables and replicated-log files.

Frames are not splittable, so a file is a partition.  Files are read through
Spark's own file source, whatever store they lie in; the bytes are decoded in
Arrow batches.  New data belongs in Parquet; the encoders exist so that old
readers can be fed and tests can go round.
"""

from __future__ import annotations

import bisect
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlume.schemas import MAX_FRAME

# Fixed values of the file formats.
PUT, DELETE = 1, 2
MAGIC = 0xDC5F00DA
CHECKSUM_FACTOR = 0x01000193
FNV_PRIME = 0x100000001B3
SEED_STEP = 0x9E3779B97F4A7C15
FOOTER, FOOTER_BYTES = "<6Q", 48

WAL = "file string, seq long, op string, key binary, value binary"
SST = "file string, key binary, value binary"
RAFT = "file string, term long, index long, command binary"
STATE = "file string, current_term long, voted_for int"
#: Bytes from which a new sorted table begins, and frames or entries of a file.
TABLE_BYTES = 32 * 1024 * 1024
FILE_ROWS = 50_000


def checksum(data: bytes) -> int:
    """The log's own checksum; it is no CRC-32."""
    c = 0
    for b in data:
        c = (c >> 8) ^ (((c ^ b) * CHECKSUM_FACTOR) & 0xFFFFFFFF)
    return c


def encode_frame(op: str, seq: int, key: bytes, value: bytes = b"") -> bytes:
    body = struct.pack("<BQI", PUT if op == "PUT" else DELETE, seq, len(key)) + key + struct.pack("<I", len(value)) + value
    return struct.pack("<II", checksum(body), len(body)) + body


def decode_frames(data: bytes):
    """(seq, op, key, value) of the valid prefix: reading ends at the first frame
    that is short, empty, too long or damaged."""
    at = 0
    while at + 8 <= len(data):
        check, size = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if size == 0 or size > MAX_FRAME or len(body) < size or checksum(body) != check or size < 17:
            return
        kind, seq, k = struct.unpack_from("<BQI", body)
        if 17 + k > size:
            return
        (v,) = struct.unpack_from("<I", body, 13 + k)
        if 17 + k + v > size:
            return
        yield seq, "PUT" if kind == PUT else "DEL", body[13 : 13 + k], body[17 + k : 17 + k + v]
        at += 8 + size


def _hash(key: bytes, seed: int) -> int:
    h = seed * SEED_STEP & (1 << 64) - 1
    for b in key:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


class Bloom:
    """The filter of a sorted table."""

    def __init__(self, bits: bytearray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def sized(cls, keys: int, rate: float = 0.01) -> Bloom:
        from kvlume.operators.bloom import sizing

        bits, hashes = sizing(keys, rate)
        return cls(bytearray(bits // 8), hashes)

    def places(self, key: bytes):
        return [_hash(key, i) % (8 * len(self.bits)) for i in range(self.hashes)]

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.bits[p // 8] |= 1 << p % 8

    def may_contain(self, key: bytes) -> bool:
        return all(self.bits[p // 8] >> p % 8 & 1 for p in self.places(key))

    def encode(self) -> bytes:
        return struct.pack("<iI", self.hashes, len(self.bits)) + bytes(self.bits)

    @classmethod
    def decode(cls, data: bytes) -> Bloom:
        hashes, n = struct.unpack_from("<iI", data)
        return cls(bytearray(data[8 : 8 + n]), hashes)


def encode_table(rows: dict[bytes, bytes]) -> bytes:
    """A sorted table: records, index, filter, footer."""
    out, index, bloom = bytearray(), [], Bloom.sized(1024)
    for key in sorted(rows):
        record = struct.pack("<I", len(key)) + key + struct.pack("<I", len(rows[key])) + rows[key]
        index.append(struct.pack("<I", len(key)) + key + struct.pack("<QQ", len(out), len(record)))
        bloom.add(key)
        out += record
    index_at, index_data, bloom_data = len(out), struct.pack("<I", len(index)) + b"".join(index), bloom.encode()
    out += index_data + bloom_data
    return bytes(out + struct.pack(FOOTER, index_at, len(index_data), index_at + len(index_data), len(bloom_data), len(index), MAGIC))


def decode_footer(data: bytes) -> tuple[int, ...] | None:
    """Index and filter places and the entries; None if it is no table."""
    if len(data) < FOOTER_BYTES:
        return None
    f = struct.unpack_from(FOOTER, data, len(data) - FOOTER_BYTES)
    return f[:5] if f[5] == MAGIC else None


def decode_table(data: bytes):
    """(key, value) in key order; nothing for a file that is no table."""
    footer = decode_footer(data)
    if footer is None:
        return
    at, (n,) = footer[0] + 4, struct.unpack_from("<I", data, footer[0])
    for _ in range(n):
        (k,) = struct.unpack_from("<I", data, at)
        key = data[at + 4 : at + 4 + k]
        offset, _size = struct.unpack_from("<QQ", data, at + 4 + k)
        at += 20 + k
        (v,) = struct.unpack_from("<I", data, offset + 4 + k)
        yield key, data[offset + 8 + k : offset + 8 + k + v]


def encode_entries(entries) -> bytes:
    return b"".join(struct.pack("<QQI", t, i, len(c)) + c for t, i, c in entries)


def decode_entries(data: bytes):
    at = 0
    while at + 20 <= len(data):
        term, index, n = struct.unpack_from("<QQI", data, at)
        if n > MAX_FRAME or at + 20 + n > len(data):
            return
        yield term, index, data[at + 20 : at + 20 + n]
        at += 20 + n


def encode_state(term: int, voted_for: int | None) -> bytes:
    """A node's term and vote; -1 is no vote."""
    return struct.pack("<Qi4x", term, -1 if voted_for is None else voted_for)


def decode_state(data: bytes):
    if len(data) >= 16:
        term, vote = struct.unpack_from("<Qi", data)
        yield term, None if vote < 0 else vote


def point_reads(data: bytes, keys: list[bytes]):
    """(key, value) of those of ``keys`` that a sorted table holds: the filter is
    asked first, then the index by bisection."""
    footer = decode_footer(data)
    if footer is None:
        return
    bloom = Bloom.decode(data[footer[2] : footer[2] + footer[3]])
    asked = [k for k in keys if bloom.may_contain(k)]
    if not asked:
        return
    at, index = footer[0] + 4, []
    for _ in range(footer[4]):
        (k,) = struct.unpack_from("<I", data, at)
        index.append((data[at + 4 : at + 4 + k], struct.unpack_from("<Q", data, at + 4 + k)[0]))
        at += 20 + k
    for key in asked:
        i = bisect.bisect_left(index, (key,))
        if i < len(index) and index[i][0] == key:
            offset = index[i][1] + 4 + len(key)
            (v,) = struct.unpack_from("<I", data, offset)
            yield key, data[offset + 4 : offset + 4 + v]


def _write(files: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A file for each row of ``content``. Spark's text writer commits them, so
    they can lie in any store; it ends each file with a zero byte, which is the
    last one of a table's footer and which readers of the other formats skip."""
    text = files.select(*by, F.col("content").cast("string").alias("value"))
    text.write.mode("errorifexists").option("lineSep", "\0").option("maxRecordsPerFile", 1).partitionBy(*by).text(path)


def _packed(rows: DataFrame, by: str | None, encode) -> DataFrame:
    """Rows in order as files of ``FILE_ROWS`` records; ``by`` names the column
    that starts a new file where it changes, and comes first in ``rows``."""

    def run(batches):
        held, owner = [], None
        out = lambda: pa.RecordBatch.from_arrays([*([pa.array([owner], pa.int64())] if by else []), pa.array([b"".join(held)], pa.binary())], names=[*([by] if by else []), "content"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == FILE_ROWS or (by and row[0] != owner)):
                    yield out()
                    held = []
                owner = row[0]
                held.append(encode(*row))
        if held:
            yield out()

    return rows.mapInArrow(run, f"{f'{by} long, ' if by else ''}content binary")


def write_wal(log: DataFrame, path: str) -> None:
    """seq, op, key, value as log files, each in ascending seq."""
    rows = log.select(F.col("seq").cast("long"), "op", F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
    _write(_packed(rows.repartitionByRange("seq").sortWithinPartitions("seq"), None, lambda seq, op, key, value: encode_frame(op, seq, key, value)), path)


def write_raft(log: DataFrame, path: str) -> None:
    """node_id, term, index, command as replicated-log files, by node."""
    rows = log.select(F.col("node_id").cast("long"), F.col("term").cast("long"), F.col("index").cast("long"), F.col("command").cast("binary"))
    in_order = rows.repartitionByRange("node_id", "index").sortWithinPartitions("node_id", "index")
    _write(_packed(in_order, "node_id", lambda _node, term, index, command: encode_entries([(term, index, command)])), path, ("node_id",))


def write_state(states: DataFrame, path: str) -> None:
    """node_id, current_term, voted_for as state files, by node."""
    rows = states.select(F.col("node_id").cast("long"), F.col("current_term").cast("long"), F.col("voted_for").cast("int"))
    _write(_packed(rows, "node_id", lambda _node, term, vote: encode_state(term, vote)), path, ("node_id",))


def write_tables(runs: DataFrame, path: str) -> None:
    """level, sst_id, key, value as sorted tables, by level and run. A long run
    becomes several tables of ascending keys."""

    def run(batches):
        rows, size, owner = {}, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([owner[0]], pa.int32()), pa.array([owner[1]], pa.int64()), pa.array([encode_table(rows)[:-1]], pa.binary())], names=["level", "sst_id", "content"])
        for batch in batches:
            for level, sst, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (size > TABLE_BYTES or (level, sst) != owner):
                    yield out()
                    rows, size = {}, 0
                owner = (level, sst)
                rows[key] = value
                size += len(key) + len(value)
        if rows:
            yield out()

    rows = runs.select(F.col("level").cast("int"), F.col("sst_id").cast("long"), F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
    in_order = rows.repartitionByRange("level", "sst_id", "key").sortWithinPartitions("level", "sst_id", "key")
    _write(in_order.mapInArrow(run, "level int, sst_id long, content binary"), path, ("level", "sst_id"))


def _read(spark: SparkSession, path: str, glob: str, schema: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for row in decode(data.as_py()):
                    rows.append((name, *row))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def read_wal(spark: SparkSession, path: str, glob: str = "*.wal") -> DataFrame:
    """file, seq, op, key, value of log files; replay is idempotent by seq."""
    return _read(spark, path, glob, WAL, decode_frames)


def read_tables(spark: SparkSession, path: str, glob: str = "*.sst") -> DataFrame:
    """file, key, value of sorted tables; files that are none are skipped."""
    return _read(spark, path, glob, SST, decode_table)


def read_raft(spark: SparkSession, path: str, glob: str = "raft_log.dat") -> DataFrame:
    """file, term, index, command of replicated-log files."""
    return _read(spark, path, glob, RAFT, decode_entries)


def read_state(spark: SparkSession, path: str, glob: str = "raft_state.dat") -> DataFrame:
    """file, current_term, voted_for (null: none) of state files."""
    return _read(spark, path, glob, STATE, decode_state)


def lookup(spark: SparkSession, path: str, keys: list[str], glob: str = "*.sst") -> DataFrame:
    """file, key, value of a short list of keys in sorted tables."""
    wanted = [k.encode() for k in keys]
    return _read(spark, path, glob, SST, lambda data: point_reads(data, wanted))


def checksums(frames: list[bytes]) -> np.ndarray:
    return np.array([checksum(f) for f in frames], np.int64)
