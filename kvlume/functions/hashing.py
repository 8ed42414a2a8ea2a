"""Stable hashes as column expressions; the same in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlume.schemas import SEGMENTS


def md5_word(key: Column, start: int = 1) -> Column:
    """The eight hex digits of md5(key) from ``start`` (1, 9, 17 or 25) on, as a long."""
    return F.conv(F.substring(F.md5(key), start, 8), 16, 10).cast("bigint")


def capacity_of(total: Column, segments: int = SEGMENTS) -> Column:
    """Each segment's share of a capacity, as ``schemas.segment_capacity`` gives it."""
    return F.greatest(F.lit(1).cast("long"), F.floor(total / segments))


def segment_of(key: Column, segments: int = SEGMENTS) -> Column:
    """The hash segment of a key."""
    return (md5_word(key) % segments).cast("int")
