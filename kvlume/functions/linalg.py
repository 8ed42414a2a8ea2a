"""Matrices as rows of arrays: (row id, ARRAY<DOUBLE>), column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matmul(row: Column, weights: list[list[float]]) -> Column:
    """A row times a small matrix given by its rows."""
    return F.array(*[dot(row, literal([w[j] for w in weights])) for j in range(len(weights[0]))])


def matmul_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in long form (i, j, v): a join on the inner index
    and a partial aggregate, for matrices too large for a literal."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def long_form(df: DataFrame, row: str, values: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def tanh(a: Column) -> Column:
    return F.transform(a, F.tanh)


def tanh_gradient(a: Column) -> Column:
    return F.transform(a, lambda x: 1 - F.pow(F.tanh(x), F.lit(2)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(0.0), x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """0 for an empty row."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(0.0)


def column_sums(df: DataFrame, values: str) -> DataFrame:
    return df.select(F.posexplode(values).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("sum"))
