"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints: 64 bits from the XXH64 of 3-word shingles.  Links: fingerprints at
Hamming distance ``RADIUS`` or less.  Every bit position gets a vector of
RADIUS + 1 bits; for each non-zero vector v there is a table whose key is the
fingerprint under the mask of the positions with odd inner product with v.  At
most RADIUS positions differ in a pair, so some v is orthogonal to all their
vectors: in that table the pair has equal keys.  No pair is missed, and there
are 2 ** (RADIUS + 1) - 1 tables.

Only different fingerprints enter the tables, so copies cost nothing.  In a
bucket of up to ``SMALL_BUCKET`` fingerprints all pairs are compared.  Larger
buckets have another exact way whose work is linear in their size: two
fingerprints are within distance 2 exactly if one of the 65 words at distance 1
or less from one is also one of those of the other, so members are linked to
the least member around each such word.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import SPACED, Words, add_result, as_string, column_name
from kvlume.llm.components import components, join_keys
from kvlume.llm.store import cut

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Members of a bucket that are compared in pairs, at most.
SMALL_BUCKET = 24

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(w: Words, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk, and offsets by document."""
    from xxhash import xxh64_intdigest

    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    off = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(w.doc[:-1] - off[:-1], n) + np.arange(off[-1])
    last = np.minimum(first + size, np.repeat(w.doc[1:], n))
    buf = w.buf.tobytes()
    starts, ends = w.start[first].tolist(), (w.start[last] - 1).tolist()
    return np.array([xxh64_intdigest(buf[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64), off


def majority_bits(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per document the bits that are set in more than half of its hashes."""
    n = len(off) - 1
    size = np.diff(off)
    # blocks of at most 255 hashes: byte lanes then cannot overflow
    blocks = -(-size // 255)
    begin = np.concatenate(([0], np.cumsum(blocks)))
    start = np.repeat(off[:-1], blocks) + 255 * (np.arange(begin[-1]) - np.repeat(begin[:-1], blocks))
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    some = np.flatnonzero(size)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, start)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), begin[:-1][some], axis=0, dtype=np.int64)
        bit = (2 * count > size[some][:, None]).astype(np.uint64)
        out[some] |= (bit << (np.uint64(8) * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "simhash", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct column ``name`` that holds ``fp``, a signed long.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased. Texts with fewer
    words than a shingle have one shingle of all; null and empty texts have none
    and the fingerprint 0.
    """
    docs = as_string(docs, text_col)

    def start():
        def one(texts):
            h, off = shingle_hashes(Words(texts, SPACED), size, seed)
            return [pa.array(majority_bits(h, off).view(np.int64))]

        return one

    return add_result(docs, text_col, start, T.StructType([T.StructField("fp", T.LongType())]), name)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: position i carries vector i mod (2 ** (radius + 1) - 1) + 1."""
    n = 1 << (radius + 1)
    vector = [i % (n - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints: all that are within
    ``radius`` up to transitivity through such links, so components are exact."""
    if radius != 2:
        raise ValueError("large buckets are linked by words at distance 1, which fits radius 2")
    tables = fps.select(F.col(fp).alias("fp")).withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))]))).select("fp", "k.t", "k.key")
    sizes = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = tables.join(sizes, ["t", "key"])
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    few = shared.where(F.col("n") <= small).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small_links = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    many = shared.where(F.col("n") > small).select("fp").distinct()
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    around = many.select("fp", F.explode(words).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    large_links = around.join(least, "word").where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return small_links.unionByName(large_links).distinct()


def _own(docs: DataFrame, text_col: str, id_col: str, **kw) -> DataFrame:
    name = column_name(docs.select(id_col, text_col), "simhash")
    return fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, name, **kw).select(F.col(id_col).alias("id"), F.col(name)["fp"].alias("fp"))


def _classes(own: DataFrame) -> DataFrame:
    """Each fingerprint with its least id and the root of its component."""
    classes = own.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    found = components(links(classes))
    return classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """A row per document: id, ``fp`` and ``component_id``, the smallest id of the
    documents that links reach from it, itself included.

    Null ids do not count as smallest; texts without words are linked like any
    others, by fingerprint 0. Repeated rows give repeated results.
    """
    own = cut(_own(docs, text_col, id_col, **kw))
    grouped = _classes(own)
    roots = grouped.where(F.col("root") != F.col("fp")).select("root").distinct()
    linked = grouped.join(roots, "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    class_of = grouped.join(smallest, "root", "left").select("fp", "size", F.coalesce("smallest", "least").alias("component_id"))
    return join_keys(own, cut(class_of), "fp", "size", own.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near copies: texts whose 5-word shingles are
    similar by 0.8 or more, directly or by way of others (see ``near_copies``)."""
    from kvlume.llm import near_copies

    return near_copies.deduplicate(docs, text_col, id_col)


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
