"""Deterministic per-row draws from md5.

Draws come from a hash of (key, stream, seed), never from ``rand()``, so the
same seed gives the same rows however the data is partitioned, and a lost task
recomputes identical values. The 32-bit integer is the first 8 hex digits of
md5; DuckDB computes the same number with ``('0x'||substr(md5(x),1,8))::bigint``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash32(col: Column | str) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(col)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash32_sql(expr: str) -> str:
    """The same integer in DuckDB SQL."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def keyed(key: Column | str, *parts) -> Column:
    """md5 input ``key|part1|part2...`` as one string column."""
    c = F.col(key) if isinstance(key, str) else key
    items = [c.cast("string")]
    for p in parts:
        items.append(F.lit("|"))
        items.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*items)


def uniform(key: Column | str, stream: str, seed: int) -> Column:
    """U(0,1) strictly inside the interval: (h + 0.5) / 2^32."""
    return (hash32(keyed(key, stream, seed)) + F.lit(0.5)) / F.lit(TWO_32)


def normal(key: Column | str, stream: str, seed: int) -> Column:
    """N(0,1) by Box-Muller over two hashed uniforms."""
    u1 = uniform(key, stream + ":a", seed)
    u2 = uniform(key, stream + ":b", seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
