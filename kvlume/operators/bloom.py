"""Bloom filters as relations of set bit positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlume.functions.hashing import md5_word


def sizing(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits (ten a key, whole bytes, 64 at least) and hashes of a filter."""
    bits = max(64, keys * 10)
    return (bits + 7) // 8 * 8, max(1, int(-math.log(rate) / math.log(2)))


def bits_of(keys: Column) -> Column:
    """The bits of filters of so many keys, as ``sizing`` gives them."""
    return F.floor((F.greatest(F.lit(64).cast("long"), keys * 10) + 7) / 8) * 8


def positions(key: Column, bits: int, hashes: int) -> Column:
    """A key's bit positions by double hashing."""
    a, b = md5_word(key, 1), md5_word(key, 9)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (a + i * b) % bits)


def build(keys: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """The set positions (``pos``), at most ``bits`` rows however many keys."""
    return keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("pos")).distinct()


def may_contain(probes: DataFrame, filter_: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """Probe keys with ``maybe``: all their positions are set."""
    spread = probes.select(key).distinct().select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("pos"))
    found = spread.join(filter_.withColumn("_set", F.lit(True)), "pos", "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))
