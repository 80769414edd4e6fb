"""Exact quantiles (linear interpolation, pandas' default) without a value map in one task.

Rows become counts per distinct value (combined before the shuffle), a sliced
running count gives each value the ranks it covers, and a quantile reads the
values of its two neighbouring ranks. A group holding a third of all rows is
spread over all slices; what leaves the running count is two rows per group and
quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe
from cohortflow.functions.windows import prefix_sum, slice_count
from cohortflow.session import materialize


def grouped_quantiles(long: DataFrame, by: Sequence[str], qs: Sequence[float], value: str = "value",
                      out: str = "q", weight: str | None = None) -> DataFrame:
    """(by..., ``out``: array of the ``qs`` quantiles of ``value``) per group.

    Nulls and NaN are left out; a group without other values gives no row. Null
    group values are groups of their own. A row stands for ``weight`` rows, where
    given. The rows are read once: running counts and totals come from the written counts.
    """
    by, qs = list(by), [float(q) for q in qs]
    x = F.col(value).cast("double")
    n = F.lit(1) if weight is None else F.col(weight)
    counts = (long.select(*by, x.alias("_v"), n.cast("long").alias("_n")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*by, "_v").agg(F.sum("_n").alias("_n")))
    counts = materialize(counts, "counts")
    run = prefix_sum(counts, by, ["_v"], ["_n"], out_prefix="_cum", slices=slice_count(counts), written=True)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        run = join_null_safe(run, total, by)
    else:  # one row
        n = total.first()["_total"]
        run = run.withColumn("_total", F.lit(n or 0).cast("long"))
    at = [F.lit(q) * (F.col("_total") - 1) for q in qs]
    ranks = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), (F.floor, F.ceil)[k](p).alias("r"))
                      for j, p in enumerate(at) for k in (0, 1)])
    mine = F.filter(ranks, lambda s: (s["r"] >= F.col("_cum_n") - F.col("_n")) & (s["r"] < F.col("_cum_n")))
    hits = run.select(*by, "_v", "_total", F.explode(mine).alias("s"))
    cells = hits.groupBy(*by).agg(
        F.first("_total").alias("_total"),
        *[F.max(F.when((F.col("s.j") == j) & (F.col("s.k") == k), F.col("_v"))).alias(f"_q{j}_{k}")
          for j in range(len(qs)) for k in (0, 1)])

    def between(j: int):
        lo, hi = F.col(f"_q{j}_0"), F.col(f"_q{j}_1")
        part = at[j] - F.floor(at[j])
        return F.when(part == 0, lo).otherwise((1 - part) * lo + part * hi)

    return cells.select(*by, F.array(*[between(j) for j in range(len(qs))]).alias(out))


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                     out: str = "q") -> DataFrame:
    """(by..., column, ``out``) for numeric columns; a column without values gives no row."""
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.inline(pairs))
    return grouped_quantiles(long, [*by, "column"], qs, out=out)


def quantile_map(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """{column: quantiles}: one number per column and quantile reaches the driver."""
    found = {r["column"]: list(r["q"]) for r in column_quantiles(df, cols, qs).collect()} if cols else {}
    return {c: found.get(c, [None] * len(qs)) for c in cols}


def median_map(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantile_map(df, cols, [0.5]).items()}
