"""Writing pages as WARC archives and reading them back by segment reassembly.

Writing: a response record per page holds an HTTP message with chunked framing;
a page whose payload another one has too becomes a revisit.  Blocks longer than
``SEGMENT_BYTES`` are split into a first record and continuation records.  The
archives are gzip files that Spark's text writer commits: its line separator is
the blank lines that end a record, so they can lie in any store.

Reading: records are parsed file by file, one in hand at a time, then brought together by origin identifier, ordered by
segment number, checked against the total length, and the chunked transfer
framing is decoded.  Only pieces of segmented records travel with their bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import chunks
from kvlume.llm.components import join_keys
from kvlume.llm.store import cut

SEGMENT_BYTES = 16_384
CHUNK = 4_096
RECORDS_PER_FILE = 1_500
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record, or records that should make one, that can't be read."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            raise BadRecord("bad chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise BadRecord("chunk too short")
        parts.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing decoded."""
    head, gap, body = block.partition(END)
    if not gap or not head.startswith(b"HTTP/"):
        raise BadRecord("no HTTP message")
    fields = _fields(head)
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unchunk(body)
    length = fields.get("content-length")
    if length is not None and int(length) != len(body):
        raise BadRecord("body differs from Content-Length")
    return body


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(record_id: str, page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment: int = SEGMENT_BYTES):
    """The records of a page; ``refers_to`` makes it a revisit."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    common = [("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        common.append(("WARC-Page-ID", page_id))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to)], head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(pieces) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}.{i}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(i)), *last], piece)


def parse(data: bytes | Iterable[bytes]):
    """(fields, block) of each record of an archive that comes whole or in pieces,
    of which one record is held at a time; a damaged rest gives one record with
    the field ``error``."""
    pieces, held, at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def upto(size: int) -> bool:
        """Whether there are so many bytes from ``at`` on; reads what is needed."""
        nonlocal at
        while len(held) - at < size:
            more = next(pieces, None)
            if more is None:
                return False
            del held[:at]
            at = 0
            held.extend(more)
        return True

    while upto(1):
        seen = 0
        while (head_end := held.find(END, at + seen)) < 0:
            seen = max(0, len(held) - at - len(END))
            if not upto(len(held) - at + 1):
                break
        if head_end < 0 or not held.startswith(b"WARC/1.", at):
            yield {"error": "not a record"}, b""
            return
        fields = _fields(bytes(held[at:head_end]))
        size, head = fields.get("content-length", ""), head_end + len(END) - at
        if not size.isdigit() or not upto(head + int(size) + len(END)) or held[at + head + int(size) : at + head + int(size) + len(END)] != END:
            yield {"error": "block differs from Content-Length"} | {k: v for k, v in fields.items() if k.startswith("warc-")}, b""
            return
        yield fields, bytes(held[at + head : at + head + int(size)])
        at += head + int(size) + len(END)


def join_segments(pieces: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of pieces (number, total length or None, bytes) in any order."""
    pieces = sorted(pieces, key=lambda p: p[0])
    if [p[0] for p in pieces] != list(range(1, len(pieces) + 1)):
        raise BadRecord("a segment is missing or repeated")
    if pieces[-1][1] is None or any(p[1] is not None for p in pieces[:-1]):
        raise BadRecord("the total length is not in the last segment")
    block = b"".join(p[2] for p in pieces)
    if len(block) != pieces[-1][1]:
        raise BadRecord("segments differ from the total length")
    return block


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and ``first``: the smallest id with an equal
    payload of ``least`` bytes or more, where that is another row's id."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    long = F.octet_length("payload") >= least
    # equal payloads are found without the payloads themselves
    narrow = rows.where(long).select("page_id", digest)
    firsts = cut(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = cut(join_keys(narrow, firsts, "digest", "n", total).where(~F.col("first").eqNullSafe(F.col("page_id"))).distinct())
    other = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    own = rows.where(long).select("*", digest)
    whole = own.join(other, own["page_id"].eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")
    return whole.unionByName(rows.where(~long).select("*", digest, F.lit(None).cast(rows.schema["page_id"].dataType).alias("first")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per row to gzip archives under ``path``.

    Null bodies are empty payloads. Of equal payloads of 100 bytes or more the
    row with the smallest id is the response; rows that share that id are all
    responses. Null ids sort after all others. An empty table writes no records.
    """

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for part in chunks(batch, lengths):
                out = []
                for page, url, payload, digest, first in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    name = hashlib.md5(f"{page}/{digest}/{task}/{row}".encode()).hexdigest()
                    record_id = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"
                    out += page_records(record_id, page, url, payload, digest, first, date, segment_bytes)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = with_revisits(pages, id_col, url_col, body_col)
    ready = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"))
    records = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_PARSED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("total", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("error", T.StringType()),
])
_READ = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


def _checked(payload: bytes, digest: str | None) -> tuple[int, str]:
    got = hashlib.sha256(payload).hexdigest()
    if digest is not None and digest != got:
        raise BadRecord("payload differs from its digest")
    return len(payload), got


def _inflated(data: bytes, size: int = 4_000_000) -> Iterator[bytes]:
    """The bytes of a plain or gzip file (of any number of members), a few at a time."""
    if not data.startswith(b"\x1f\x8b"):
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    while data:
        z = zlib.decompressobj(31)
        while data and not z.eof:
            piece = z.decompress(data, size)
            data = z.unconsumed_tail
            if piece:
                yield piece
        data = z.unused_data


def read_archives(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """A row per page of the archives under ``path``: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, error and, if asked for, payload.

    Records that can't be read have their reason in ``error`` and no payload.
    A revisit's length and digest are those its record states; it is an error
    if no readable response of the page it names has that digest.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for f, block in parse(_inflated(data.as_py())):
                    kind, number = f.get("warc-type"), f.get("warc-segment-number")
                    key = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    total, size, error, keep = f.get("warc-segment-total-length"), None, f.get("error"), None
                    if error is None:
                        try:
                            if number is not None:
                                keep = block
                            elif kind == "revisit":
                                size = int(_fields(block.partition(END)[0]).get("content-length", "0"))
                            elif kind == "response":
                                payload = http_payload(block)
                                size, digest = _checked(payload, digest)
                                keep = payload if with_payload else None
                            else:
                                continue  # warcinfo, metadata and the like
                        except (BadRecord, ValueError) as e:
                            error = str(e)
                    rows.append((key, f.get("warc-page-id"), f.get("warc-target-uri"), kind, f.get("warc-refers-to-page-id"), digest, int(number) if number else None, int(total) if total else None, size, keep, error))
                    held += len(keep or b"")
                    if held > 4_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_PARSED)
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(run, _PARSED)
    pieces = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "block")))
    whole = F.col("type") != "continuation"
    only = lambda c: F.max(F.when(whole, F.col(c)))
    grouped = parsed.groupBy("key").agg(*[only(c).alias(c) for c in ("page_id", "url", "type", "refers_to", "digest", "size")], F.max("error").alias("error"), F.max(F.when(F.col("number").isNull(), F.col("block"))).alias("payload"), pieces.alias("pieces"))

    def assemble(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("pieces")), 0).to_numpy(zero_copy_only=False)
            for part in chunks(batch, sizes, 64):
                out = []
                for own in part.select(["digest", "size", "error", "payload", "pieces"]).to_pylist():
                    size, digest, payload, error = own["size"], own["digest"], own["payload"], own["error"]
                    if own["pieces"] and error is None:
                        try:
                            payload = http_payload(join_segments([(p["number"], p["total"], p["block"]) for p in own["pieces"]]))
                            size, digest = _checked(payload, digest)
                        except (BadRecord, ValueError) as e:
                            size = payload = None
                            error = str(e)
                    out.append((size, digest, payload if with_payload else None, error))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url", "type", "refers_to")], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["page_id", "url", "record_type", "refers_to", *_READ.names])

    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in ("page_id", "url", "record_type", "refers_to")], *_READ.fields])
    out = grouped.mapInArrow(assemble, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    out = out if with_payload else cut(out.drop("payload"))
    answers = out.where((F.col("record_type") == "response") & F.col("error").isNull()).select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    lost = cut(out.where(F.col("record_type") == "revisit").select("refers_to", "payload_digest").distinct().join(answers, ["refers_to", "payload_digest"], "left_anti"))
    if lost.isEmpty():
        return out
    marked = out.join(lost.select(F.col("refers_to").alias("_r"), F.col("payload_digest").alias("_d")), (F.col("record_type") == "revisit") & F.col("refers_to").eqNullSafe(F.col("_r")) & F.col("payload_digest").eqNullSafe(F.col("_d")), "left")
    reason = F.when(F.col("_d").isNotNull() | F.col("_r").isNotNull(), F.coalesce("error", F.lit("no readable response has this payload"))).otherwise(F.col("error"))
    return marked.withColumn("error", reason).select(out.columns)
