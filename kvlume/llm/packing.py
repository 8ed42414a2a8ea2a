"""Packing documents into sequences of a fixed number of tokens.

Documents are tokenised where they lie and cut into pieces.  Only a histogram
of piece lengths (at most ``max_tokens`` rows, whatever the corpus) reaches the
driver.  There, patterns of two or three lengths that fill a sequence exactly
are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded, and the remaining pieces are packed by best fit,
longest first, on the histogram.  The plan says which ranks of each length go
into which sequences; its size depends on ``max_tokens`` only.  A piece's rank
among those of its length is its rank in its task plus the counts of the tasks
before it, so no task ever holds all pieces of a common length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import as_string, chunks, process_cache
from kvlume.llm.store import cut

MAX_TOKENS = 2048
END_ID = 0


def _latin(text: str) -> bool:
    return text.isascii() or re.search("[^\0-ɏ]", text) is None


class Tokens:
    """Ids of a text by a byte-level BPE of the tokenizers library.

    With a file of the same vocabulary as ranks, texts of Latin letters and no
    special tokens are encoded by tiktoken, which gives the same ids faster.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self._slow, self.fast = path, None, None
        with open(path) as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", ())]
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _latin(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, text_col: str = "text", id_col: str = "doc_id", max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 and, if asked for,
    ids; besides, ``task`` and the piece's ``rank`` in it among equal lengths.

    A null text is empty: one piece that holds the end id alone. A document of
    more than ``max_tokens`` is cut so that only its first piece may be shorter.
    """
    docs = as_string(docs, text_col).select(F.col(id_col), F.col(text_col))
    fields = [docs.schema.fields[0], *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "task", "rank")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType([T.StructField(f"_{i}" if i == 0 else f.name, f.dataType) for i, f in enumerate(fields)])

    def run(batches):
        tokens = process_cache(("tokens", tokenizer_path, ranks_path), lambda: Tokens(tokenizer_path, ranks_path, pattern))
        task = TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in chunks(batch, lengths):
                row, out, ids_out = [], [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(tokens.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                    at, k = 0, 0
                    end = len(ids) % max_tokens or min(max_tokens, len(ids))
                    while at < len(ids):
                        own = ids[at:end]
                        row.append(r)
                        out.append((k, at, len(own), zlib.crc32(own.tobytes()), task, seen[len(own)]))
                        if with_ids:
                            ids_out.append(own.astype(np.int64))
                        seen[len(own)] += 1
                        at, end, k = end, end + max_tokens, k + 1
                cols = [part.column(0).take(pa.array(row, pa.int64())), *[pa.array(c) for c in np.array(out, np.int64).reshape(-1, 6).T]]
                if with_ids:
                    cols.append(pa.array(ids_out, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed("_0", id_col)


def exact_patterns(lengths: np.ndarray, total: int) -> np.ndarray:
    """Pairs and triples (with a leading 0 for pairs) of the given lengths that
    add up to ``total``, each in ascending order."""
    lengths = np.unique(lengths[(lengths > 0) & (lengths < total)])
    have = np.zeros(total + 1, bool)
    have[lengths] = True
    have[0] = True
    out = []
    for a in [0, *lengths.tolist()]:
        rest = total - a
        b = lengths[(lengths >= max(a, 1)) & (2 * lengths <= rest)]
        b = b[have[rest - b]]
        out.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(out).astype(np.int64)


def fit(histogram: np.ndarray, patterns: np.ndarray, steps: int = 5_000, least: float = 0.5) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - histogram|^2, by
    coordinate descent: each step takes the coordinate that lowers the error
    most to its own optimum. It stops when no step would change a count by
    ``least``, which rounding would lose, or after ``steps``; what is not fitted
    then is packed with the residuals."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    residual = histogram.astype(float).copy()
    residual[0] = 0
    same = (patterns[:, :1] == patterns[:, 1:2]).astype(int) * (patterns[:, :1] > 0) + (patterns[:, 1:2] == patterns[:, 2:])
    same = same[:, 0]
    norm = np.where(patterns[:, 0] > 0, 3.0, 2.0) + np.where(same == 1, 2, np.where(same == 2, 6, 0))
    grad = residual[patterns].sum(axis=1)
    # the patterns that use a length, and how often: once if not listed again below
    pair, often = np.unique(patterns.ravel() * len(patterns) + np.repeat(np.arange(len(patterns)), 3), return_counts=True)
    users = pair % len(patterns)
    where = np.searchsorted(pair // len(patterns), np.arange(len(histogram) + 1))

    def gains(at):
        step = grad[at] / norm[at]
        return np.where(step < 0, np.minimum(-step, x[at]), step) ** 2 * norm[at]

    gain = gains(slice(None))
    for _ in range(steps):
        j = int(np.argmax(gain))
        d = max(grad[j] / norm[j], -x[j])
        if abs(d) < least:
            break
        x[j] += d
        for length in patterns[j]:
            if length:
                residual[length] -= d
                own = slice(where[length], where[length + 1])
                grad[users[own]] -= d * often[own]
        for length in patterns[j]:
            if length:
                own = users[where[length] : where[length + 1]]
                gain[own] = gains(own)
    return x


class Plan:
    """Runs ``(length, first rank, count, first sequence, offset)``: the ranks of
    a length from the first on go, one each, to the sequences from the first on."""

    def __init__(self, histogram: np.ndarray, total: int, patterns: np.ndarray, x: np.ndarray):
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.left = histogram.astype(np.int64).copy()
        self.left[0] = 0
        self.used = np.zeros_like(self.left)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            members = [int(v) for v in patterns[j] if v]
            n = min(int(round(x[j])), *[int(self.left[v]) // members.count(v) for v in members])
            if n > 0:
                at = 0
                for v in reversed(members):
                    self._take(v, n, self.sequences, at)
                    at += v
                self.sequences += n
        self.patterned = self.sequences
        self._best_fit(total)

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _best_fit(self, total: int) -> None:
        free: list[list[tuple[int, int]]] = [[] for _ in range(total + 1)]  # by space: sequences (first, count)
        some = np.zeros(total + 1, bool)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while (n := int(self.left[length])) > 0:
                fits = np.flatnonzero(some[length:])
                if len(fits):
                    space = length + int(fits[0])
                    first, count = free[space].pop()
                    if count > n:
                        free[space].append((first + n, count - n))
                        count = n
                    some[space] = bool(free[space])
                    self._take(length, count, first, total - space)
                    space -= length
                else:
                    per = total // length
                    count = max(1, n // per)
                    per = min(per, n)
                    first, self.sequences = self.sequences, self.sequences + count
                    for k in range(per):
                        self._take(length, count, first, k * length)
                    space = total - per * length
                if space:
                    free[space].append((first, count))
                    some[space] = True

    @classmethod
    def best(cls, histogram: np.ndarray, total: int, shares: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5)) -> Plan:
        """The plan with the fewest sequences among those that use these shares
        of the fitted counts: short pieces left over fill gaps of the rest."""
        patterns = exact_patterns(np.flatnonzero(histogram), total)
        x = fit(histogram, patterns)
        return min((cls(histogram, total, patterns, x * share) for share in shares), key=lambda p: p.sequences)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the runs' first ranks, sequences and offsets."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << 48) | runs[:, 1], runs[:, 3], runs[:, 4]


def assign(found: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` instead of task and rank.

    The pieces are checkpointed, so ranks stay as they are when executors are
    lost. A full piece is a sequence of its own, with a negative number.
    """
    found = cut(found)
    short = found.where(F.col("length") < max_tokens)
    counts = cut(short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(max_tokens + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    spark = found.sparkSession
    plan = spark.sparkContext.broadcast(Plan.best(histogram, max_tokens).table())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_base"))
    ranked = short.join(base, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))).withColumn("rank", F.col("rank") + F.col("_base"))
    columns = [c for c in found.columns if c not in ("task", "rank")]
    ranked = ranked.select(*columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(batches):
        key, sequence, offset = plan.value
        start = key & ((1 << 48) - 1)
        for batch in batches:
            rank = batch.column(batch.num_columns - 2).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence[at] + rank - start[at]), pa.array(offset[at])], names=batch.schema.names)

    full = found.where(F.col("length") == max_tokens).select(*columns, (-1 - F.col("task") * (1 << 40) - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, ranked.schema).unionByName(full)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, **kw) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each goes to.

    Offsets in a sequence have no gaps from 0 on. Repeated rows are packed one
    by one, null ids are carried along, and an empty table gives no pieces.
    """
    return assign(pieces(docs, tokenizer_path, max_tokens=max_tokens, **kw), max_tokens)
