"""Comparing Spark results with SQL results."""

from __future__ import annotations

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same(df, con, sql: str) -> None:
    """Equal column names, types and rows in any order."""
    names = sorted(df.columns)
    listed = ", ".join(f'"{n}"' for n in names)
    rel = con.execute(f"SELECT {listed} FROM ({sql})")
    assert {n: TYPES[dict(df.dtypes)[n]] for n in names} == {d[0]: str(d[1]) for d in rel.description}
    want = sorted(repr(tuple(r)) for r in rel.fetchall())
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
