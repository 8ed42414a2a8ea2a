"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order.  Each model is a logistic regression
on word features and on the logits of all earlier categories.  While learning,
those logits are out-of-fold: a row's come from models that have not seen it, so
later models learn to trust earlier ones only as far as they can be trusted on
new texts.  The models kept are then fitted on all rows.

Features are hashed: each word, and its beginnings of four to eight bytes where
it is longer; a feature's value is log(1 + its tokens).  Each model looks for
the features that differ most between its classes in its own training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import Words, add_result, as_string, chunks, column_name, share
from kvlume.llm.lang_id import LETTERS

#: Labelled documents to learn from, at most; whole texts, however long.
SAMPLE_ROWS = 8_000
HASH_BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 3
#: Features of a model, at most, and how clearly (in standard errors) and in how
#: many rows a feature must show.
MAX_FEATURES = 3_000
MIN_Z = 4.0
MIN_ROWS = 4

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number of each token, and a row of feature numbers (-1: none) for
    each different word of the chunk."""
    coded = w.array().dictionary_encode()
    words = coded.dictionary
    k = len(words)
    if not k:
        return np.zeros(0, np.int64), np.zeros((0, 1 + len(PREFIXES)), np.int64)
    off = np.frombuffer(words.buffers()[1], np.int64, k + 1, words.offset * 8)
    data = np.append(np.frombuffer(words.buffers()[2], np.uint8), np.zeros(16, np.uint8))
    size = np.diff(off) - 1  # without the space

    def eight(start, upto):
        out = np.zeros(k, np.uint64)
        for i in range(8):
            out |= np.where(start + i < upto, data[np.minimum(start + i, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * i)
        return out

    head, second, tail = eight(off[:-1], off[1:] - 1), eight(off[:-1] + 8, off[1:] - 1), eight(np.maximum(off[:-1], off[1:] - 9), off[1:] - 1)

    def mixed(x, salt):
        x = (x ^ np.uint64(salt)) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))

    whole = mixed(mixed(head, 1) + _M2 * second + _M3 * tail + size.astype(np.uint64), 2)
    columns = [whole]
    for p in PREFIXES:
        own = head if p == 8 else head & np.uint64((1 << 8 * p) - 1)
        columns.append(mixed(own, 100 + p))
    ids = np.stack([(c >> np.uint64(64 - HASH_BITS)).astype(np.int64) for c in columns], axis=1)
    for i, p in enumerate(PREFIXES):
        ids[size <= p, 1 + i] = -1
    return coded.indices.to_numpy(zero_copy_only=False), ids


def text_features(w: Words, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, tokens) of a chunk, of the ``chosen`` features only."""
    token, ids = word_features(w)
    if chosen is not None:
        ids = np.where(ids >= 0, chosen[ids], -1)
    useful = (ids >= 0).any(axis=1) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(useful[token]) if len(token) else token
    doc = np.repeat(np.arange(len(w.doc) - 1), w.counts)[at]
    own = ids[token[at]]
    keep = own >= 0
    key = (np.repeat(doc, ids.shape[1]).reshape(own.shape)[keep] << HASH_BITS) | own[keep]
    pair, n = np.unique(key, return_counts=True)
    return pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1), n


class Rows:
    """Sparse rows: (row, feature, value), sorted by row."""

    def __init__(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray):
        self.n, self.row, self.feature, self.value = n, row, feature, value

    @classmethod
    def of(cls, lists: pa.ChunkedArray) -> Rows:
        """Of packed rows (see ``packed``), one for each row."""
        size = np.array([len(x) // 8 for x in lists.to_pylist()], np.int64)
        own = np.frombuffer(b"".join(lists.to_pylist()), np.dtype([("feature", "<i4"), ("value", "<f4")]))
        return cls(len(size), np.repeat(np.arange(len(size), dtype=np.int32), size), own["feature"].copy(), own["value"].copy())


def packed(texts: pa.Array) -> list[bytes]:
    """The features of each text with their values, four bytes each."""
    row, feature, tokens = text_features(Words(texts, LETTERS))
    own = np.zeros(len(row), np.dtype([("feature", "<i4"), ("value", "<f4")]))
    own["feature"], own["value"] = feature, np.log1p(tokens)
    off = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    return [own[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)]


class Linear:
    """Logistic regression on chosen features and some dense columns."""

    def __init__(self, x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 300, l2: float = 1e-3):
        size = 1 << HASH_BITS
        own, pos = use[x.row], y[x.row]
        n1, n0 = max(1, y[use].sum()), max(1, (~y[use]).sum())
        c1 = np.bincount(x.feature[own & pos], minlength=size)
        c0 = np.bincount(x.feature[own & ~pos], minlength=size)
        p = (c1 + c0) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        z = np.where((c1 + c0 >= MIN_ROWS) & np.isfinite(z), z, 0)
        self.features = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])
        self.features = self.features[z[self.features] >= MIN_Z]
        slot = np.full(size, -1)
        slot[self.features] = np.arange(len(self.features))
        at = np.flatnonzero(own & (slot >= 0)[x.feature])
        renumber = np.cumsum(use) - 1
        row, col, value = renumber[x.row[at]], slot[x.feature[at]], x.value[at].astype(float)
        d, t = dense[use], y[use].astype(float)
        n, k = len(t), len(self.features)
        w, b, v = np.zeros(k), np.log(n1 / n0), np.zeros(d.shape[1])
        # gradient steps scaled by each coordinate's curvature, with momentum
        hw = np.bincount(col, value * value, minlength=k)[:k] / 4 + l2 * n
        hv, hb = (d * d).sum(axis=0) / 4 + l2 * n, n / 4
        load = max(1.0, np.bincount(row, minlength=n).mean() + d.shape[1] + 1)
        mw, mb, mv = 0 * w, 0.0, 0 * v
        for _ in range(steps):
            s = np.bincount(row, value * w[col], minlength=n) + d @ v + b
            r = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - t
            mw = 0.8 * mw - (np.bincount(col, value * r[row], minlength=k)[:k] + l2 * n * w) / hw / load
            mv = 0.8 * mv - (d.T @ r + l2 * n * v) / hv / load
            mb = 0.8 * mb - r.sum() / hb / load
            w, v, b = w + mw, v + mv, b + mb
        self.w, self.b, self.v = w, b, v

    def logit(self, x: Rows, dense: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << HASH_BITS)
        table[self.features] = self.w
        return np.bincount(x.row, x.value * table[x.feature], minlength=x.n)[: x.n] + dense @ self.v + self.b


def best_threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between neighbouring predictions that splits best."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-logit, kind="stable")
    hit, s = np.cumsum(y[order]), logit[order]
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(np.argmax(f1))
    cut = (s[k] + s[min(k + 1, len(s) - 1)]) / 2
    return float(1 / (1 + np.exp(-cut)))


class Chain:
    """A classifier chain over named categories."""

    def __init__(self, x: Rows, labels: dict[str, np.ndarray], fold: np.ndarray, folds: int = FOLDS):
        self.names = list(labels)
        self.models: list[Linear] = []
        #: Probabilities from which a category counts as present: those that gave
        #: the best F1 on the out-of-fold predictions.
        self.thresholds: dict[str, float] = {}
        earlier = np.zeros((x.n, 0))
        every = np.ones(x.n, bool)
        for name in self.names:
            y = labels[name].astype(bool)
            self.models.append(Linear(x, earlier, y, every))
            held = np.zeros(x.n)
            for k in range(folds):
                out = fold == k
                if out.any() and not out.all():
                    held[out] = Linear(x, earlier, y, ~out).logit(x, earlier)[out]
            self.thresholds[name] = best_threshold(held, y)
            earlier = np.column_stack([earlier, np.clip(held, -15, 15)])

    @property
    def features(self) -> np.ndarray:
        return np.unique(np.concatenate([m.features for m in self.models])) if self.models else np.zeros(0, np.int64)

    def probabilities(self, x: Rows) -> np.ndarray:
        earlier = np.zeros((x.n, 0))
        for m in self.models:
            earlier = np.column_stack([earlier, np.clip(m.logit(x, earlier), -15, 15)])
        return 1 / (1 + np.exp(-earlier))


def train(docs: DataFrame, labels: DataFrame, categories: dict, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Chain | None:
    """Learns ``categories`` (name: condition on the columns of ``labels``, in
    chain order) from at most ``rows`` labelled documents, those with the smallest
    hash of their id (ties go by id). Null conditions count as false; of several
    rows of ``labels`` with one id a category holds if it holds in one of them; of
    several texts with one id the first in order is taken; unlabelled documents
    and null texts are left out. Texts become features on the executors. None if
    there are no rows."""
    docs = as_string(docs, text_col)
    names = [f"_c{i}" for i in range(len(categories))]
    named = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in zip(names, categories.values(), strict=True)], F.xxhash64(id_col).bitwiseAND(F.lit((1 << 40) - 1)).alias("_h"))
    n = named.count()
    if not n:
        return None
    # twice the wanted rows by hash, then exactly the first ones: small enough to be broadcast
    few = named.where(F.col("_h") < F.lit(min(1 << 40, int(2 * rows / n * (1 << 40)) + 1)))
    some = few.groupBy("_id", "_h").agg(*[F.max(c).alias(c) for c in names]).orderBy("_h", "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    sample = texts.join(F.broadcast(some), "_id").groupBy("_id", "_h", *names).agg(F.min("_text").alias("_text")).drop("_id")

    def run(batches):
        for whole in batches:
            at = whole.schema.names.index("_text")
            sizes = pc.binary_length(whole.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in chunks(whole, sizes):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("_h", *names)], pa.array(packed(part.column(at)), pa.binary())], names=["_h", *names, "_x"])

    rows_ = sample.mapInArrow(run, T.StructType([T.StructField("_h", T.LongType()), *[T.StructField(c, T.BooleanType()) for c in names], T.StructField("_x", T.BinaryType())])).toArrow().sort_by([("_h", "ascending")])
    if not rows_.num_rows:
        return None
    y = {name: np.array(rows_[c].to_pylist(), bool) for c, name in zip(names, categories, strict=True)}
    return Chain(Rows.of(rows_["_x"]), y, rows_["_h"].to_numpy() % FOLDS)


def predict(docs: DataFrame, chain: Chain | None, text_col: str = "text", name: str = "toxicity", categories: tuple[str, ...] = ("toxic",)) -> DataFrame:
    """``docs`` with a struct column ``name`` (underscores are added where a column
    has it already): a probability for each category.

    Null and empty texts have probability 0 everywhere, and so have all texts in
    ``categories`` where nothing was learned (no chain). Rows are judged one by one, so copies get equal results; an
    empty table gives an empty result.
    """
    docs = as_string(docs, text_col)
    names = chain.names if chain else []
    shared = share(docs.sparkSession, chain)

    def start():
        c = shared()
        slot = np.full(1 << HASH_BITS, -1)
        slot[c.features] = c.features

        def one(texts):
            w = Words(texts, LETTERS)
            row, feature, tokens = text_features(w, slot)
            p = c.probabilities(Rows(len(texts), row, feature, np.log1p(tokens)))
            p[w.counts == 0] = 0.0
            return list(p.T)

        return one

    if not names:
        return docs.withColumn(column_name(docs, name), F.struct(*[F.lit(0.0).alias(c) for c in categories]))
    return add_result(docs, text_col, start, T.StructType([T.StructField(n, T.DoubleType()) for n in names]), name)
