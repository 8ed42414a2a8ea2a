"""Shared plumbing: row-preserving Arrow operators and byte-level tokenising.

Row-local operators append one struct column to whatever columns the input
has; where a column has its name already, underscores are added to it.  A
pipeline stage can filter on the struct and keep the original columns without a
join.
"""

from __future__ import annotations

import ctypes
import pickle
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import kvlume.llm

# Executors get these functions inside the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(kvlume.llm)

#: Bytes of text handled at a time in a Python worker; bounds its memory. A
#: longer text is a chunk of its own.
CHUNK_BYTES = 1_500_000


def process_cache(key, make: Callable):
    """A value kept for the life of the Python process (tokenizers, tables)."""
    store = sys.modules.setdefault("_kvlume_process_cache", types.ModuleType("_kvlume_process_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def share(spark, value) -> Callable[[], object]:
    """Broadcasts ``value``; the result gives it in a task. It travels as bytes
    with its classes, as a plain broadcast would need an installed copy."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def share_arrays(spark, value) -> Callable[[], object]:
    """As ``share``, for a value of large arrays. They travel beside the rest, so
    neither the driver nor a worker holds them twice; in tasks they are read-only,
    as a worker's tasks have one copy."""
    buffers = []
    rest = cloudpickle.dumps(value, protocol=5, buffer_callback=buffers.append)
    arrays = [np.frombuffer(b.raw(), np.uint8) for b in buffers]
    for a in arrays:
        a.flags.writeable = False
    data = spark.sparkContext.broadcast((rest, arrays))
    return lambda: pickle.loads(data.value[0], buffers=data.value[1])


def give_back() -> None:
    """Returns to the system the free memory that Arrow and malloc hold on to. Spark
    keeps workers, so a task would otherwise add to what those before it left."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores added until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def chunks(batch: pa.RecordBatch, lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text and one row at least."""
    n = batch.num_rows
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def add_result(df: DataFrame, text_col: str, start: Callable[[], Callable], fields: T.StructType, name: str) -> DataFrame:
    """Appends struct column ``name`` (see ``column_name``); ``start()`` gives, once
    a task, a function from a chunk's text array to one Arrow array per field."""
    from pyspark.sql.pandas.types import to_arrow_schema

    name = column_name(df, name)
    at = df.columns.index(text_col)
    kinds = list(to_arrow_schema(fields))

    def run(batches):
        one = start()
        for batch in batches:
            text = batch.column(at)
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in chunks(batch, lengths):
                got = [pa.array(a, k.type) if not isinstance(a, pa.Array) else a.cast(k.type) for a, k in zip(one(part.column(at)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(got, fields=kinds)], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, fields)]))


def as_string(df: DataFrame, text_col: str) -> DataFrame:
    """The text column as a string, whatever type it came as (void, for one)."""
    return df if dict(df.dtypes)[text_col] == "string" else df.withColumn(text_col, F.col(text_col).cast("string"))


def byte_table(keep: Callable[[int], bool]) -> bytes:
    """Maps A-Z to a-z, kept bytes to themselves and all others to a space."""
    low = bytes(range(256)).lower()
    return bytes(b if keep(b) else 32 for b in low)


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_table(lambda b: b not in b" \t\n\v\f\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case
ALNUM = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)


def flat(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts' bytes with a newline after each, and n + 1 offsets into them;
    a null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    n = len(joined)
    if not n:
        return b"", np.zeros(1, np.int64)
    off = np.frombuffer(joined.buffers()[1], np.int64, n + 1, joined.offset * 8)
    return joined.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes(), off - off[0]


class Words:
    """Words of a chunk of texts.

    ``buf``: the words, lower-cased, each followed by one space; ``start``: n + 1
    offsets of the words in it; ``doc``: offsets of the documents' first words.
    """

    def __init__(self, texts: pa.Array, table: bytes):
        raw, off = flat(texts)
        raw = np.frombuffer(raw.translate(table), np.uint8)
        word = raw != 32
        keep = word.copy()
        keep[1:] |= word[:-1]  # the space that ends a word; each text ends in one
        self.buf = raw[keep]
        ends = np.flatnonzero(self.buf == 32)
        self.start = np.concatenate(([0], ends + 1)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(keep)))[off] if len(off) else np.zeros(1, np.int64)
        self.doc = np.searchsorted(self.start, first)
        self.n = len(ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def array(self) -> pa.Array:
        """The words with their spaces, as an Arrow array without copying."""
        return pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(self.start), pa.py_buffer(np.ascontiguousarray(self.buf)))


def list_of_strings(items: list[str | None]) -> pa.Array:
    return pa.array(items, pa.string())
