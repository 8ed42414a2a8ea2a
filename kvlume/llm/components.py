"""Connected components by alternating large-star and small-star rounds.

Links stay distributed; each round's links are checkpointed.  A node's links are
never gathered in one place: a round is an aggregate and a join, and what the
aggregate says of nodes with a large share of all links, which are few by
definition, is broadcast, so that a hub's links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlume.llm.store import cut


#: A key with more than one row in ``SHARE`` is heavy; fewer than ``SHARE`` keys can be.
SHARE = 500


def join_keys(rows: DataFrame, keys: DataFrame, by: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keys`` (one row for each ``by``, which must
    know them all; ``size``: how many of the ``total`` rows have it). Heavy keys
    are broadcast, fewer than ``SHARE`` of them; the others are joined by shuffle."""
    heavy = keys.where(F.col(size) * SHARE > total).drop(size)
    light = keys.where(F.col(size) * SHARE <= total).drop(size)
    columns = [*rows.columns, *[c for c in heavy.columns if c != by]]
    return rows.join(F.broadcast(heavy), by).select(columns).unionByName(rows.join(F.broadcast(heavy.select(by)), by, "left_anti").join(light, by).select(columns))


def _least(links: DataFrame, total: int) -> DataFrame:
    """``u``, ``v`` and the least of u and all its neighbours, ``m``."""
    return join_keys(links, links.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("size")), "u", "size", total)


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v) for each named pair of columns of each row."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("p")).select("p.u", "p.v")


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root``, the least node of its component, from links (a, b).

    Nodes without links do not appear. Loops and repeated links do not matter.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    state, total = None, edges.count()
    for _ in range(rounds):
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        large = _least(both, 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _pairs(_least(large, total), ("v", "m"), ("u", "m")).where(F.col("u") != F.col("v")).distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if now == state:
            break
        state, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
