"""The metrics document, as one JSON text built from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """One row: ``value`` by ``order`` as an array. For a fixed number of rows
    (segments, nodes, levels, the last 50 events)."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def document(fields: DataFrame) -> DataFrame:
    return fields.select(F.to_json(F.struct(*fields.columns)).alias("metrics"))


def nested(name: str, *parts: DataFrame) -> DataFrame:
    """One-row frames as one struct column."""
    row = one_row(*parts)
    return row.select(F.struct(*row.columns).alias(name))


def structs_in_order(df: DataFrame, order: str, name: str) -> DataFrame:
    """One row: the rows by ``order``, which stands first in each, as an array of
    structs; for a fixed number of rows."""
    columns = [order, *[c for c in df.columns if c != order]]
    return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
