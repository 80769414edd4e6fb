"""Distributed running sums without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task,
and ``Window.partitionBy(group)`` puts a group holding a third of all rows
into one task. ``prefix_sum`` cuts its input into slices of about
``SLICE_ROWS`` rows, as many as the rows need (the cluster's shuffle partitions
at most): rows get a *slice* from the sort key compared with boundaries drawn
from a bounded sample. Each (slice, group) gets its local running sum in a
window; the per-(slice, group) totals -- at most #groups + slices rows -- get an
exclusive running sum over slices, joined back (null-safe) as an offset. Rows
that fit one slice need neither boundaries nor offsets.

The input is written once (Parquet, compressed columns), so the sample, the local sums and the totals
read the same written rows, and the slice is a pure function of the row's key
(literal boundaries): any recomputation after a lost executor agrees. Order
keys must be numeric (descending = negated; nulls come first either way); rows
with equal (group, order) keys must have been aggregated first, as every caller
does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.session import materialize

#: Keys sampled for each slice boundary.
SAMPLED = 32
#: Rows of a slice, about.
SLICE_ROWS = 65_536


def _sort_exprs(order: Sequence[str], descending: bool) -> list[Column]:
    if descending:
        return [F.col(c).desc_nulls_first() for c in order]
    return [F.col(c).asc_nulls_first() for c in order]


def window_prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence[str],
                      cols: Sequence[str], descending: bool = False,
                      inclusive: bool = True, out_prefix: str = "cum_",
                      next_col: str | None = None) -> DataFrame:
    """Plain-window running sum of the rows of one slice; what tests compare slices with."""
    frame_end = Window.currentRow if inclusive else -1
    w0 = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_sort_exprs(order, descending))
    w = w0.rowsBetween(Window.unboundedPreceding, frame_end)
    extra = [F.lead(order[0]).over(w0).alias(next_col)] if next_col else []
    return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{out_prefix}{c}")
                            for c in cols], *extra)


def _slice_expr(df: DataFrame, key: Column, slices: int) -> Column:
    """Slice id = number of sampled boundaries strictly below the row's key.

    The sample is the SAMPLED x slices keys of least hash, so it needs no row
    count and is the same whenever it is drawn again. The boundaries are a
    sorted literal array of key structs; the count is a binary search (``aggregate`` over log2(#boundaries) steps, JVM-side), so
    a row costs O(log slices) comparisons however many slices the cluster uses.
    """
    import math

    keyed = df.select(key.alias("_k"))
    ktype = keyed.schema["_k"].dataType
    least = keyed.withColumn("_h", F.xxhash64("_k")).orderBy("_h").limit(SAMPLED * slices)
    sample = [r["_k"] for r in least.select("_k").orderBy("_k").collect()]
    if not sample:
        return F.lit(0)
    bounds = []
    for i in range(1, slices):
        b = sample[min(len(sample) - 1, (len(sample) * i) // slices)]
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    arr = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, ktype.fields)])
                    for b in bounds])
    nb = len(bounds)
    steps = max(1, math.ceil(math.log2(nb + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.lit(nb).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.element_at(arr, mid + 1) < key
        nxt = F.when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi"))) \
               .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, nxt).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def slice_count(df: DataFrame) -> int:
    """Slices that the rows of ``df`` (written, as they are counted) need."""
    partitions = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return max(1, min(partitions, -(-df.count() // SLICE_ROWS)))


def prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence[str],
               cols: Sequence[str], descending: bool = False,
               inclusive: bool = True, out_prefix: str = "cum_",
               slices: int | None = None, next_col: str | None = None, written: bool = False) -> DataFrame:
    """Add ``<out_prefix><c>`` = running sum of ``c`` within ``by`` ordered by ``order``.

    ``inclusive=False`` gives the sum over strictly earlier rows. ``next_col``
    also adds the next row's first order key (a lead that crosses slices).
    Null group values form groups of their own. ``slices``: the ``slice_count`` of
    the rows where a caller has it, as for several running sums of one table;
    ``written``: ``df`` is read from its files already.
    """
    by, order, cols = list(by), list(order), list(cols)
    if slices is None:
        df = materialize(df, "slices")
        slices = slice_count(df)
    elif slices > 1 and not written:
        df = materialize(df, "slices")
    if slices <= 1:
        return window_prefix_sum(df, by, order, cols, descending, inclusive, out_prefix, next_col)

    ord_keys = [(-F.col(c) if descending else F.col(c)) for c in order]
    key = F.struct(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)],
                   *[k.alias(f"_o{i}") for i, k in enumerate(ord_keys)])
    sliced = df.withColumn("_slice", _slice_expr(df, key, slices))

    frame_end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy("_slice", *by).orderBy(*_sort_exprs(order, descending))
               .rowsBetween(Window.unboundedPreceding, frame_end))
    w_lead = Window.partitionBy("_slice", *by).orderBy(*_sort_exprs(order, descending))
    extra = [F.lead(order[0]).over(w_lead).alias("_lead")] if next_col else []
    local = sliced.select(
        "*", *[F.coalesce(F.sum(c).over(w_local), F.lit(0)).alias(f"_loc_{c}") for c in cols], *extra)

    first = (F.max if descending else F.min)(order[0]).alias("_first")
    totals = sliced.groupBy("_slice", *by).agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols], first)
    # One row per (slice, group): without groups, `slices` rows at most.
    w_next = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_slice")
    w_off = w_next.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_slice").alias("_slice_r"), *[F.col(b).alias(f"_by_r{i}") for i, b in enumerate(by)],
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}") for c in cols],
        F.lead("_first").over(w_next).alias("_next_first"))

    on = F.col("_slice") == F.col("_slice_r")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by_r{i}"))
    joined = local.join(offsets, on, "inner")
    extra_out = [F.coalesce(F.col("_lead"), F.col("_next_first")).alias(next_col)] if next_col else []
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{out_prefix}{c}") for c in cols],
        *extra_out)
