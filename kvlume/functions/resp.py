"""The wire protocol: replies as column expressions, requests as tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
PARSED = "tokens array<string>, consumed int, error string"


def simple_string(s: Column) -> Column:
    return F.concat(F.lit("+"), s, F.lit(CRLF))


def error(message: Column) -> Column:
    return F.concat(F.lit("-ERR "), message, F.lit(CRLF))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit(CRLF))


def bulk_string(s: Column) -> Column:
    return F.concat(F.lit("$"), F.octet_length(s).cast("string"), F.lit(CRLF), s, F.lit(CRLF))


def null() -> Column:
    return F.lit(f"$-1{CRLF}")


def array(items: Column) -> Column:
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit(CRLF), F.array_join(F.transform(items, bulk_string), ""))


def inline_tokens(line: Column) -> Column:
    """Tokens of an inline command: up to CRLF, else LF, else all, split at white space."""
    end = F.when(F.instr(line, CRLF) > 0, F.instr(line, CRLF)).when(F.instr(line, "\n") > 0, F.instr(line, "\n"))
    first = F.when(end.isNotNull(), F.substring(line, F.lit(1), end - 1)).otherwise(line)
    return F.filter(F.split(first, r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def parse_one(buf: bytes) -> tuple[list[str], int, str | None]:
    """Tokens and bytes used of the first command; none while it is incomplete.

    A bad number is reported as an error instead of ending the reader.
    """
    if not buf.startswith(b"*"):
        for mark in (b"\r\n", b"\n"):
            at = buf.find(mark)
            if at >= 0:
                return [t.decode("utf-8", "replace") for t in buf[:at].split()], at + len(mark), None
        return [t.decode("utf-8", "replace") for t in buf.split()], len(buf), None
    try:
        end = buf.find(b"\r\n")
        if end < 0:
            return [], 0, None
        left, at, tokens = int(buf[1:end]), end + 2, []
        while left > 0:
            end = buf.find(b"\r\n", at)
            if at >= len(buf) or end < 0:
                return [], 0, None
            if buf[at : at + 1] != b"$":
                tokens.append(buf[at + 1 : end])
                at = end + 2
            else:
                size = int(buf[at + 1 : end])
                at = end + 2
                if size < 0:
                    tokens.append(b"")
                elif at + size + 2 > len(buf):
                    return [], 0, None
                else:
                    tokens.append(buf[at : at + size])
                    at += size + 2
            left -= 1
        return [t.decode("utf-8", "replace") for t in tokens], at, None
    except ValueError:
        return [], 0, "Protocol error: bad length"


def parse_all(buf: bytes) -> list[tuple[list[str], int, str | None]]:
    """Every complete command of a pipelined buffer."""
    out = []
    while buf:
        tokens, used, bad = parse_one(buf)
        if bad or not used:
            return [*out, (tokens, used, bad)] if bad else out
        out.append((tokens, used, None))
        buf = buf[used:]
    return out


def parse(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a struct ``parsed``; length prefixes need a parser, which gets
    Arrow batches."""

    @F.pandas_udf(PARSED)
    def one(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_one(bytes(b) if b is not None else b"") for b in s], columns=["tokens", "consumed", "error"])

    return df.withColumn("parsed", one(F.col(column).cast("binary")))
