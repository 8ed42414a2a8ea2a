"""Benchmark decontamination with suffix arrays over the training text.

Each chunk of documents is a shard: its words become dense identifiers, and a
word-level suffix array is built over all of them (three words packed in one
64-bit key are sorted at once, then rank doubling over the ties only).  Every
suffix of every benchmark item is looked up by binary search in every shard.
That yields all places where the window that starts there occurs, and how much
further each of them matches: the longest verbatim match of every document, with
its location.  Documents are never shuffled.

The benchmark is shared in blocks of at most ``BLOCK_BYTES`` of text.  A larger
benchmark takes several passes over the documents; every pass adds its hits to
those of the passes before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import ALNUM, Words, add_result, as_string, column_name, share
from kvlume.llm.store import cut

WINDOW = 8
#: Benchmark text sent to the executors at a time.
BLOCK_BYTES = 16_000_000

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),  # starts and ends of hit runs, in words, by turns
    T.StructField("items", T.ArrayType(T.StringType())),  # ids of items with occurring windows, sorted
    T.StructField("longest_match", T.LongType()),  # words of the longest run of an item, a window at least, found here
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_item_start", T.LongType()),
    T.StructField("longest_doc_start", T.LongType()),
])


class Items:
    """A block of the benchmark: item ids, coded words, and where the suffixes
    start. ``rank`` orders suffixes by item id, then by place."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        w = Words(pa.array(texts, pa.string()), ALNUM)
        coded = w.array().dictionary_encode()
        self.ids, self.vocabulary, self.doc = ids, coded.dictionary, w.doc
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.item = np.repeat(np.arange(len(ids)), np.diff(w.doc))
        self.start = np.arange(w.n) - w.doc[self.item]
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i].encode(), i))] = np.arange(len(ids))
        self.rank = np.empty(w.n, np.int64)
        self.by_rank = np.lexsort((self.start, place[self.item]))
        self.rank[self.by_rank] = np.arange(w.n)


def _dense(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers from 1 of the shard's words and of the items' words; 0 ends a
    document, and words the shard lacks get -1."""
    coded = w.array().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    index = pa.compute.index_in(items.vocabulary, value_set=coded.dictionary)
    return ids, (pa.compute.fill_null(index, -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[items.codes]


def _pack3(x: np.ndarray) -> np.ndarray:
    """Three neighbours in one key; identifiers stay below 2 ** 21 in a shard."""
    a = np.zeros(len(x) + 2, np.int64)
    a[: len(x)] = x
    return (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of x (identifiers from 1, 0 ends a document) to the ends of
    documents, and the sorted keys of the first three symbols."""
    wide = len(x) and int(x.max()) >= 1 << 21
    if wide:  # a single text of over two million different words
        sa = np.argsort(x, kind="stable")
        key, have = x[sa], 1
    else:
        packed = _pack3(x)
        sa = np.argsort(packed, kind="stable")
        key, have = packed[sa], 3
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(x) else np.zeros(0, bool)
    rank = np.zeros(len(x) + 1, np.int64)
    group = np.flatnonzero(first)
    rank[sa] = np.repeat(group, np.diff(np.append(group, len(x)))) + 1
    # past the end of a document nothing needs order: its end marks it as settled
    ends = np.flatnonzero(x == 0)
    ahead = np.full(len(x), len(x), np.int64)
    if len(ends):
        nxt = np.searchsorted(ends, np.arange(len(x)))
        ahead = np.where(nxt < len(ends), ends[np.minimum(nxt, len(ends) - 1)], len(x)) - np.arange(len(x))
    size = np.diff(np.append(group, len(x)))
    tied = np.repeat(size > 1, size)
    spots = np.flatnonzero(tied)
    while len(spots):
        at = sa[spots]
        live = ahead[at] >= have
        live_groups = np.zeros(len(x) + 2, bool)
        live_groups[rank[at[live]]] = True
        keep = live_groups[rank[at]]
        spots, at = spots[keep], at[keep]
        if not len(spots):
            break
        own, then = rank[at], rank[np.minimum(at + have, len(x))]
        then = np.where(ahead[at] >= have, then, 0)
        order = np.lexsort((then, own))
        at, own, then = at[order], own[order], then[order]
        sa[spots] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])))
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        fresh = np.repeat(spots[begin] + 1, length)
        rank[at] = fresh
        spots = spots[np.repeat(length > 1, length)]
        have *= 2
    return sa, (key if have >= 3 and not wide else None)


def search(x: np.ndarray, sa: np.ndarray, query: np.ndarray, starts: np.ndarray, limits: np.ndarray):
    """Walks every query suffix down the suffix array, a symbol at a time: yields
    the depth, the suffixes that still match and the ranges that they match."""
    alive = np.arange(len(starts))
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    at = 0
    xs = np.append(x, 0)
    while len(alive):
        more = starts[alive] + at < limits[alive]
        alive, lo, hi = alive[more], lo[more], hi[more]
        q = query[starts[alive] + at]
        left = _bound(xs, sa, lo, hi, at, q, False)
        right = _bound(xs, sa, left, hi, at, q, True)
        good = (right > left) & (q > 0)
        alive, lo, hi = alive[good], left[good], right[good]
        at += 1
        yield at, alive, lo, hi


def _bound(x, sa, lo, hi, at, q, upper):
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        pos = np.minimum(sa[np.minimum(mid, len(sa) - 1)] + at, len(x) - 1)
        v = x[pos]
        less = (v <= q) if upper else (v < q)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def _places(sa: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The suffixes of some ranges, one range after the other."""
    size = hi - lo
    return sa[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]


def match_shard(w: Words, items: Items, window: int):
    """Per document of the shard: hit runs, occurring items, longest match."""
    n = len(w.doc) - 1
    hits: list[list[int]] = [[] for _ in range(n)]
    found: list[set] = [set() for _ in range(n)]
    longest: list[tuple | None] = [None] * n
    if not w.n or not len(items.codes):
        return hits, found, longest
    ids, query = _dense(w, items)
    x = np.insert(ids, w.doc[1:], 0)
    begin = w.doc[:-1] + np.arange(n)  # where each document starts in x
    sa, _ = suffix_array(x)
    starts, limits = np.arange(len(query)), items.doc[1:][items.item]
    # windows start where 8 words follow in the item; a short item is one window
    full = np.minimum(window, np.diff(items.doc))[items.item]
    whole = starts + full <= limits
    cover = np.zeros(len(x) + 1, np.int64)
    best, owner = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    pairs = []
    for depth, alive, lo, hi in search(x, sa, query, starts, limits):
        opens = whole[alive] & (full[alive] == depth)
        if opens.any():
            own, at = alive[opens], _places(sa, lo[opens], hi[opens])
            size = (hi - lo)[opens]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + depth, -1)
            pairs.append(np.unique(np.stack([np.searchsorted(begin, at, side="right") - 1, np.repeat(items.item[own], size)]), axis=1))
        long = whole[alive] & (full[alive] <= depth)
        if long.any():  # every place that matches this far, whichever document it is in
            own, at = np.repeat(items.rank[alive[long]], (hi - lo)[long]), _places(sa, lo[long], hi[long])
            owner[at] = np.iinfo(np.int64).max
            np.minimum.at(owner, at, own)
            best[at] = depth
    for d, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else ():
        found[d].add(items.ids[i])
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    own = np.searchsorted(begin, edge[::2], side="right") - 1
    for d, a, b in zip(own.tolist(), (edge[::2] - begin[own]).tolist(), (edge[1::2] - begin[own]).tolist(), strict=True):
        hits[d] += [a, b]
    at = np.flatnonzero(best)
    if len(at):
        own = np.searchsorted(begin, at, side="right") - 1
        order = np.lexsort((at, owner[at], -best[at], own))
        own, at = own[order], at[order]
        top = np.concatenate(([True], own[1:] != own[:-1]))
        suffix = items.by_rank[owner[at[top]]]
        for d, k, j, i in zip(own[top].tolist(), at[top].tolist(), suffix.tolist(), items.item[suffix].tolist(), strict=True):
            longest[d] = (int(best[k]), items.ids[i], int(items.start[j]), int(k - begin[d]))
    return hits, found, longest


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Blocks of the benchmark of about ``limit`` bytes, one at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    n = int(total // limit) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield k + 1 == n, Items([r["id"] if r["id"] is not None else "" for r in rows], [r["text"] for r in rows])


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, name: str = "leak", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name`` (see RESULT); rows are unchanged.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.
    A null or empty text has no words and no hits; an item without words never
    occurs; a null item id counts as the empty string; rows of ``benchmark``
    with one id are one item when items are counted.  Repeated documents are
    judged one by one; an empty table gives an empty result.  The longest match
    is the longest run of words of an item, of a window at least, that stands in
    the document; of equally long ones the first by item id, place in the item
    and place in the document; null where no window occurs.  Underscores are
    added to a name that a column has already.
    """
    docs = as_string(docs, text_col)
    spark, columns = docs.sparkSession, docs.columns
    out = docs
    for last, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared, before = share(spark, block), out.columns[-1] if out is not docs else None
        new = column_name(out, name)

        def start(shared=shared):
            items = shared()

            def one(texts):
                w = Words(texts, ALNUM)
                hits, found, longest = match_shard(w, items, window)
                cols = list(zip(*[x or (None,) * 4 for x in longest], strict=True)) or [()] * 4
                return [w.counts, pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(f) for f in found], pa.list_(pa.string())), *[pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]]

            return one

        out = add_result(out, text_col, start, RESULT, new)
        if before is not None:
            out = out.withColumn(new, _merge(F.col(before), F.col(new))).drop(before)
        if not last:
            out = cut(out)
    return out.withColumnRenamed(out.columns[-1], column_name(docs, name)).select(*columns, column_name(docs, name))


def _union_runs(a, b):
    """The union of two lists of runs, each runs by turns of start and end."""
    apart = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i % 2 == 0) & (i < F.size(x))), lambda i: F.struct(F.get(x, i).alias("s"), F.get(x, i + 1).alias("e")))
    last = lambda out: F.element_at(out, -1)
    join = lambda out, r: F.when((F.size(out) > 0) & (r["s"] <= last(out)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last(out), r["e"])))).otherwise(F.concat(out, F.array(r["s"], r["e"])))
    return F.aggregate(F.array_sort(F.concat(apart(a), apart(b))), F.expr("cast(array() as array<bigint>)"), join)


def _merge(a, b):
    place = lambda x: F.when(x["longest_match"].isNotNull(), F.struct((-x["longest_match"]).alias("n"), *[x[c].alias(c) for c in ("longest_item", "longest_item_start", "longest_doc_start")]))
    best = F.least(place(a), place(b))
    return F.struct(
        a["n_words"].alias("n_words"),
        _union_runs(a["hit_spans"], b["hit_spans"]).alias("hit_spans"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        (-best["n"]).alias("longest_match"),
        *[best[c].alias(c) for c in ("longest_item", "longest_item_start", "longest_doc_start")],
    )


def n_hit(leak):
    """Hit words of a ``scan`` result."""
    spans = leak["hit_spans"]
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, text_col: str = "text", **kw) -> DataFrame:
    """The documents in which windows of fewer than ``min_items`` items occur."""
    name = column_name(docs, "leak")
    return scan(docs, benchmark, text_col=text_col, name=name, **kw).where(F.size(F.col(name)["items"]) < min_items).select(*docs.columns)

