"""Global running sums and ranks without one task holding all rows.

A window without partition keys would send every row to one task.  Here rows are
bucketed by ranges of the ordering column: a window runs inside each bucket, and
the sums of the buckets before it are added from a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = 65_536, keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with this row in
    ascending ``order`` (a whole-number column, nulls first), then ``ties``,
    within ``keys``. Keys that are null form a group of their own. ``parts`` is
    the number of tasks that sort the rows; without it Spark merges tasks up to
    a size of compressed bytes."""
    bucketed = df.withColumn("_b", F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 62)))).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0).cast("long"))).drop("_s")
    dealt = bucketed.repartition(parts, *keys, "_b") if parts else bucketed
    summed, other = dealt.withColumn("_i", F.sum("_v").over(inside)), starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), "_o")
    on = F.col("_b") == F.col("_c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(other, on).withColumn(name, F.col("_i") + F.col("_o")).drop("_b", "_c", "_v", "_i", "_o", *[f"_k{i}" for i in range(len(keys))])


def rank(df: DataFrame, order: str, name: str, width: int = 65_536, keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: its place from 1 in ascending ``order``, then ``ties``."""
    return running_sum(df, order, F.lit(1).cast("long"), name, width, keys, ties, parts)
