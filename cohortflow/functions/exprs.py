"""Small column-expression helpers shared by operators and query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round a float for export/compare; -0.0 folded into 0.0."""
    x = F.round((F.col(f"`{c}`") if isinstance(c, str) else c).cast("double"), digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def whole(x: Column) -> Column:
    """A double rounded half to even, as ``bround(x, 0)`` (which goes by decimals and takes longer); no -0.0."""
    return F.rint(x) + F.lit(0.0)


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (export at fixed precision, like CSV at %.5f)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(r6(f.name, digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def sql_r6(expr: str, digits: int = 6) -> str:
    """DuckDB twin of ``r6``."""
    r = f"round(CAST({expr} AS DOUBLE), {digits})"
    return f"(CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END)"


def small_distinct_counts(df: DataFrame, cols: list[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts for the columns that can be at most ``limit``; None
    for the others.

    A first pass of HyperLogLog sketches (merged map-side, no shuffle of
    values) rules out the high-cardinality columns; only columns whose
    estimate is within a wide margin of ``limit`` get an exact count. So a
    continuous column with billions of distinct values is never shuffled
    value by value just to learn that it is not categorical.
    """
    if not cols:
        return {}
    est = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in cols]).first()
    margin = int(limit * 1.5) + 10
    small = [c for c in cols if est[c] <= margin]
    out: dict[str, int | None] = {c: None for c in cols}
    if small:
        exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in small]).first()
        out.update({c: int(exact[c]) for c in small})
    return out


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys meet; columns: keys, rest of left, rest of right."""
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    # Own names on the right, so that every column is told by its name.
    r = right.select(*[F.col(k).alias(f"_key_r{i}") for i, k in enumerate(keys)],
                     *[F.col(c).alias(f"_val_r{i}") for i, c in enumerate(rest)])
    on = F.col(keys[0]).eqNullSafe(F.col("_key_r0"))
    for i, k in enumerate(keys[1:], 1):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_r{i}"))
    named = [F.coalesce(F.col(k), F.col(f"_key_r{i}")).alias(k) if how in ("outer", "right") else F.col(k)
             for i, k in enumerate(keys)]
    return left.join(r, on, how).select(*named, *[F.col(c) for c in left.columns if c not in keys],
                                        *[F.col(f"_val_r{i}").alias(c) for i, c in enumerate(rest)])
