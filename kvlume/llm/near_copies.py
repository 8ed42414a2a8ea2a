"""Near copies by the Jaccard similarity of word shingles.

Texts whose sets of 5-word shingles have a Jaccard similarity of ``SIMILARITY``
or more are linked.  Candidates share a key of the covering tables of their
SimHash fingerprints over the same shingles, which no pair within the radius
escapes, or one of ``BANDS`` MinHash bands of ``ROWS`` values: at a similarity
of 0.8 fingerprints differ in 10 bits of 64 on average, and covering 19 bits,
as nearly all such pairs would need, takes a million tables.  A pair at exactly
0.8 shares no band with a chance of 7e-5.  Every candidate is then judged by
the exact similarity of the two sets, so no link is wrong.

Only different sets enter.  In a bucket all are first compared with its leader,
the member that meets most others over all its buckets: of a text's edited copies
that is the text itself or one of the least edited, which is similar to far more
of them than any other.  What this has joined needs no more comparing, so a bucket
of near copies costs work in proportion to its size.  All other pairs of a bucket
are compared in a second round, where parity sketches of the sets come first: each
member that only one of two sets has turns one bit, so sketches that differ in
more bits than similar sets could have such members rule a pair out without error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import SPACED, Words, add_result, as_string, column_name, share
from kvlume.llm.components import components
from kvlume.llm.simhash import majority_bits, masks, shingle_hashes
from kvlume.llm.store import cut

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 24, 5
SEED = 42
#: Words of 64 bits in a parity sketch, a power of two.
SKETCH = 8
#: Bits of the filter that tells which sets may be asked for.
FILTER_BITS = 1 << 23

_FOUND = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *[T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH)]])
_SET = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))])
_odd = np.random.default_rng(20240102).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text the sorted set of its shingles' hashes, a hash of the set, and
    the SimHash fingerprint of the shingles."""
    from xxhash import xxh64_intdigest

    h, off = shingle_hashes(Words(texts, SPACED), size, SEED)
    sets = [np.unique(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    once = np.concatenate(sets) if sets else h
    print_ = majority_bits(once, np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64))
    return sets, np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64), print_


def covering_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of fingerprints in the covering tables, a column for each table."""
    cols = [((prints & np.uint64(m)) * _odd[t] ^ _odd[-1 - t]) * np.uint64(0x9E3779B97F4A7C15) for t, m in enumerate(masks())]
    return np.stack(cols, axis=1).view(np.int64)


def bands(sets: list[np.ndarray]) -> list:
    """The band keys of each set; an empty set has none."""
    some = [s for s in sets if len(s)]
    if not some:
        return [[] for _ in sets]
    h, start = np.concatenate(some), np.concatenate(([0], np.cumsum([len(s) for s in some])[:-1]))
    key = np.zeros((len(some), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        key[:, k // ROWS] = (key[:, k // ROWS] ^ np.minimum.reduceat(h * _odd[k], start)) * np.uint64(0x9E3779B97F4A7C15)
        if k % ROWS == ROWS - 1:
            key[:, k // ROWS] = (key[:, k // ROWS] ^ (key[:, k // ROWS] >> np.uint64(32)) ^ _odd[k // ROWS]) * _odd[0]
    own = iter(key.view(np.int64).tolist())
    return [next(own) if len(s) else [] for s in sets]


def sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The parity sketches, word by word: each member turns one bit of its set's."""
    out = np.zeros((SKETCH, len(sets)), np.uint64)
    some = np.flatnonzero([len(s) for s in sets])
    if len(some):
        h = np.concatenate([sets[i] for i in some])
        start = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
        bit = np.uint64(1) << (h & np.uint64(63))
        word = (h >> np.uint64(6)) % np.uint64(SKETCH)
        for k in range(SKETCH):
            out[k, some] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), start)
    return list(out.view(np.int64))


def described(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: ``fp`` (hash of the shingle set),
    ``n`` (its size), ``keys`` (those of its buckets; an empty set has none) and
    the words of its parity sketch."""

    def start():
        def one(texts):
            sets, fp, prints = shingle_sets(texts)
            keys = [[*b, *c] if b else [] for b, c in zip(bands(sets), covering_keys(prints).tolist(), strict=True)]
            return [pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(s) for s in sketches(sets)]]

        return one

    return add_result(docs, text_col, start, _FOUND, name)


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """fp, n and members of the sets whose fp is in ``wanted``. A filter of fixed
    size keeps most others from leaving the tasks that read the texts, and of
    copies each task gives one."""
    spark = docs.sparkSession
    low = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = np.zeros(FILTER_BITS, bool)
    # eight bytes of bits a row, so what reaches the driver is bounded too
    for r in wanted.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("b")).toLocalIterator():
        bits[r["at"] * 64 : r["at"] * 64 + 64] = np.unpackbits(np.array([r["b"]], "<i8").view(np.uint8), bitorder="little").astype(bool)
    asked = share(spark, np.packbits(bits))

    def start():
        may, given = np.unpackbits(asked()).astype(bool), set()

        def one(texts):
            sets, fp, _ = shingle_sets(texts)
            take = may[fp & (FILTER_BITS - 1)]
            for i in np.flatnonzero(take).tolist():  # a task gives each set once, however many copies it reads
                take[i] = fp[i] not in given
                given.add(fp[i])
            return [pa.array(fp), pa.array([len(s) if t else -1 for s, t in zip(sets, take, strict=True)], pa.int64()), pa.array([s.view(np.int64) if t else None for s, t in zip(sets, take, strict=True)], pa.list_(pa.int64()))]

        return one

    name = column_name(docs.select(text_col), "found")
    found = add_result(docs.select(text_col), text_col, start, _SET, name).select(f"{name}.*").where(F.col("members").isNotNull())
    return found.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def _verified(docs: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, judged by the sets."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    own = cut(_sets(docs, text_col, wanted))
    first = own.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    second = own.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    p, q = SIMILARITY
    return pairs.join(first, "a").join(second, "b").where((p + q) * both >= p * (F.col("na") + F.col("nb"))).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, text_col: str) -> DataFrame:
    """Links (a, b) between sets of ``classes`` (fp, n, keys, sketch) whose components
    are those of all candidates that are similar enough."""
    p, q = SIMILARITY
    fits = lambda x, y: (q * F.least(x, y) >= p * F.greatest(x, y))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    keys = classes.select("fp", "n", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    shared = cut(keys.join(sizes, "key"))
    # how often a set meets others, all its buckets together; the least number leads
    met = shared.groupBy("fp").agg((-F.sum("c")).alias("met"))
    leads = shared.join(met, "fp").groupBy("key").agg(F.min(F.struct("met", "fp", "n")).alias("l"))
    shared = cut(shared.join(leads, "key").select("key", "fp", "n", F.col("l.fp").alias("lead"), F.col("l.n").alias("lead_n")))
    tried = cut(shared.where((F.col("fp") != F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).select(*pair(F.col("fp"), F.col("lead"))).distinct())
    found = cut(_verified(docs, text_col, tried))
    root = components(found)
    of = lambda df, by, name: df.join(root.select(F.col("node").alias(by), F.col("root").alias("_r")), by, "left").withColumn(name, F.coalesce("_r", by)).drop("_r")
    placed = cut(of(of(shared, "fp", "root"), "lead", "lead_root"))
    # members apart from the bucket's leader, against all that are apart from them
    words = [f"s{k}" for k in range(SKETCH)]
    far = placed.where(F.col("root") != F.col("lead_root")).select("key").distinct()
    other = cut(placed.join(far, "key", "left_semi").select("key", "fp", "n", "root", (F.col("root") != F.col("lead_root")).alias("far")).join(classes.select("fp", *words), "fp"))
    apart = other.where("far").select("key", F.col("fp").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"), *[F.col(w).alias(f"x{w}") for w in words])
    turned = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w}"))) for w in words), F.lit(0))
    # members that only one of two similar sets has: (q - p) / (q + p) of all at most
    may = (q + p) * turned <= (q - p) * (F.col("n") + F.col("xn"))
    rest = apart.join(other, (apart["key"] == other["key"]) & (F.col("xr") != F.col("root")) & fits(F.col("xn"), F.col("n")) & may).select(*pair(F.col("x"), F.col("fp"))).distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return found
    return found.unionByName(_verified(docs, text_col, rest))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component of similar texts: the one with the smallest
    id (null ids come last; of texts that share that id the one whose hash is
    smallest; of repeated rows one). Texts without words, null ones too, are
    copies of one another. Other columns stay as they are, whatever their names;
    an empty table gives an empty result."""
    docs = as_string(docs, text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    found = described(narrow, "text", "found")
    own = cut(found.select("id", "mark", "found.*"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    one = cut(own.groupBy("fp").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]))
    root = components(links(docs, one, text_col))
    stay = one.join(root, one["fp"] == root["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("s")).select("s.id", "s.mark")
    copies = own.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    i, mark, more = (column_name(docs, c) for c in ("_id", "_mark", "_more"))
    stay = cut(stay.join(copies, stay["id"].eqNullSafe(copies["id"]) & (stay["mark"] == copies["mark"]), "left").select(stay["id"].alias(i), stay["mark"].alias(mark), F.col("c").isNotNull().alias(more)))
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(mark)))
    columns = [F.col(c) for c in docs.columns]
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    single = kept.where(~F.col(more)).select(*columns)
    if stay.where(more).isEmpty():
        return single
    repeated = kept.where(more).groupBy(i, mark).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
