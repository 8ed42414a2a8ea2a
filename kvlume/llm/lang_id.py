"""Language identification by prediction by partial matching.

Each language gets a tree of byte contexts up to ``ORDER`` bytes long, with the
counts of the symbols that followed them in a bounded sample of its labelled
texts.  The statistics are then frozen.  A text's code length under a language
is exact PPM-C: a symbol new to a context costs the context's escape probability
(its number of different symbols against that number plus all it counted), the
next shorter context excludes the symbols already ruled out, and after the
empty context the remaining bytes are equally likely.  The shortest code names
the language; the score is its posterior with equal priors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import Words, add_result, as_string, byte_table, chunks, column_name, share
from kvlume.llm.ngrams import Scores, grams, sums

ORDER = 4
SPACE = 32
#: Labelled rows a language is learned from, at most; whole texts, however long.
SAMPLE_ROWS = 300
UNKNOWN = "und"

#: Letters stay; all else counts as white space.
LETTERS = byte_table(lambda b: b >= 128 or 97 <= b <= 122)

RESULT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits", T.DoubleType()),  # code length under that language
    T.StructField("n_bytes", T.LongType()),  # coded bytes
])


def counted(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of some texts, ascending, and their counts."""
    return np.unique(grams(Words(texts, LETTERS), order, SPACE)[0], return_counts=True)


class Contexts:
    """Frozen statistics of one language."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int = ORDER):
        """From different grams of ``order`` + 1 bytes, ascending, and their counts."""
        self.order = order
        self.levels: list[tuple[np.ndarray, ...]] = [()] * (order + 1)
        longer = None
        for k in range(order, -1, -1):
            if k < order:
                low = key & np.uint64((1 << 8 * (k + 1)) - 1)
                key_k, back = np.unique(low, return_inverse=True)
                n_k = np.bincount(back, n, len(key_k)).astype(np.int64)
            else:
                key_k, n_k, back = key, n.astype(np.int64), None
            ctx, at = np.unique(key_k >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(at, n_k, len(ctx)), np.bincount(at, minlength=len(ctx))
            if longer is not None:
                # what the symbols of each longer context count in this one
                longer[4][:] = np.bincount(longer[5], n_k[back], len(longer[2]))
            longer = [key_k, n_k, ctx, (total, distinct), np.zeros(len(ctx)), at]
            self.levels[k] = (key_k, n_k.astype(float), ctx, total, distinct.astype(float), longer[4])
            key, n = key_k, n_k

    @classmethod
    def of(cls, texts: list[str], order: int = ORDER) -> Contexts:
        return cls(*counted(pa.array(texts, pa.string()), order), order)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code lengths of the grams' newest bytes after their older ones."""
        out = np.zeros(len(code))
        ruled_n, ruled_d = np.zeros(len(code)), np.zeros(len(code))
        live = np.arange(len(code))
        for k in range(self.order, -1, -1):
            key, n, ctx, total, distinct, below = self.levels[k]
            if not len(key):
                continue
            own = code[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            where = own >> np.uint64(8)
            c = np.minimum(np.searchsorted(ctx, where), len(ctx) - 1)
            known = ctx[c] == where
            s = np.minimum(np.searchsorted(key, own), len(key) - 1)
            found = known & (key[s] == own)
            new = np.maximum(distinct[c] - ruled_d[live], 0)
            all_ = np.maximum(total[c] - ruled_n[live], 0) + new
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(found, np.log2(all_ / n[s]), np.where(new > 0, np.log2(all_ / new), 0.0))
            out[live] += np.where(known, cost, 0.0)
            ruled_n[live] = np.where(known, below[c], 0.0)
            ruled_d[live] = np.where(known, distinct[c], 0.0)
            live = live[~found]
            if not len(live):
                return out
        out[live] += np.log2(np.maximum(256 - ruled_d[live], 1))
        return out


class Model:
    def __init__(self, trees: dict[str, Contexts], order: int = ORDER):
        self.order = order
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]

    def scorer(self) -> Scores:
        return Scores(lambda code: np.stack([t.bits(code) for t in self.trees], axis=1), len(self.langs))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order_by=None, rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model:
    """Learns from at most ``rows`` labelled texts a language, those with the
    smallest hash of ``order_by`` (the text itself by default; ties go by text).
    Texts are counted whole on the executors; only the counts of different grams
    reach the driver. Null texts and labels are left out."""
    labelled = as_string(labelled, text_col)
    key = F.xxhash64(F.col(text_col) if order_by is None else order_by).bitwiseAND(F.lit((1 << 40) - 1))
    some = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), key.alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, order)
    # twice the wanted rows by hash, then exactly the first ones of each language
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1 << 40, int(2 * rows / n * (1 << 40)))))])
    few = some.where(F.col("key") < limit[F.col("lang")])
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("r") <= rows)

    def run(batches):
        for whole in batches:
            sizes = pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in chunks(whole, sizes):
                for lang in part.column(0).unique().to_pylist():
                    key, n = counted(part.column(1).filter(pc.equal(part.column(0), lang)), order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    found = first.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    order_of = found.sort_by([("lang", "ascending"), ("gram", "ascending")])
    trees = {}
    for lang in counts:
        own = order_of.filter(pc.equal(order_of["lang"], lang))
        if own.num_rows:
            trees[lang] = Contexts(own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy(), order)
    return Model(trees, order)


def predict(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` (see RESULT), from the text alone;
    underscores are added to a name that a column has already.

    A null text, one without letters, and any text where no language was learned
    are ``und`` with score 0. Ties go to the language first in order. Rows are
    judged one by one; an empty table gives an empty result.
    """
    docs = as_string(docs, text_col)
    shared = share(docs.sparkSession, model)

    def start():
        m = shared()
        scores = m.scorer() if m.langs else None

        def one(texts):
            w = Words(texts, LETTERS)
            n = len(w.doc) - 1
            code, off = grams(w, m.order, SPACE)
            size = np.diff(off)
            letters = size > 0
            # bytes over 127 may be signs only: such texts have no ASCII letter
            ascii_letters = sums((w.buf >= 97) & (w.buf <= 122), off) > 0
            for d in np.flatnonzero(letters & ~ascii_letters).tolist():
                letters[d] = any(c.isalpha() for c in texts[d].as_py())
            lang, score, bits = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            if scores is not None and n:
                total = sums(scores.of(code), off)
                best = total.argmin(axis=1)
                bits = np.where(letters, total[np.arange(n), best], 0.0)
                post = 1 / np.exp2(np.maximum(total[np.arange(n), best][:, None] - total, -1000)).sum(axis=1)
                score = np.where(letters, np.clip(post, 0, 1), 0.0)
                lang = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            return [pa.array(lang, pa.string()), score, bits, size]

        return one

    return add_result(docs, text_col, start, RESULT, name)


def reject(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of ``min_score`` or
    more; ``und`` goes."""
    name = column_name(docs, "language")
    found = F.col(name)
    return predict(docs, model, text_col, name).where((found["lang"] != UNKNOWN) & (found["score"] >= min_score)).select(*docs.columns)
