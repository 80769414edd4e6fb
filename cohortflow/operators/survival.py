"""Survival statistics (E1-E6) as grouped DataFrame plans.

Every curve is first reduced to one row per (group, distinct time) by a
partial+final hash aggregation, so the running sums below work on distinct
times, not rows. The running sums use ``prefix_sum`` (range partitions),
never an un-partitioned window, so one huge group is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe
from cohortflow.functions.windows import prefix_sum, slice_count
from cohortflow.schema import DEFAULT, SurvivalSchema
from cohortflow.session import cut_lineage, materialize


def whole_table_key(col: str) -> Column:
    """A constant group key ("") for the whole table that the optimizer cannot
    fold: a literal key would turn joins on it into nested-loop joins."""
    return F.coalesce(F.substring(F.col(col).cast("string"), 1, 0), F.lit(""))


def event_table(df: DataFrame, sch: SurvivalSchema = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """(by..., time, d = events, c = subjects) per distinct time."""
    return df.groupBy(*by, sch.time).agg(
        F.sum(F.col(sch.status).cast("long")).alias("d"),
        F.count(F.lit(1)).alias("c"))


def kaplan_meier(df: DataFrame, sch: SurvivalSchema = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """(by..., time, n_at_risk, d, c, s) with S = prod(1 - d/n) over times <= t.

    n_at_risk is the suffix count over times >= t; S is exp of a running sum
    of ln(1 - d/n), and 0 from the first time where every subject at risk has
    the event (d = n). Times with only censoring keep S unchanged.
    """
    by = list(by)
    ev = cut_lineage(event_table(df, sch, by))
    slices = slice_count(ev)
    ev = prefix_sum(ev, by, [sch.time], ["c"], descending=True, out_prefix="_risk_", slices=slices)
    ev = ev.withColumnRenamed("_risk_c", "n_at_risk")
    n = F.col("n_at_risk").cast("double")
    d = F.col("d").cast("double")
    ev = ev.withColumn("_lf", F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0))) \
           .withColumn("_z", F.when((d >= n) & (d > 0), F.lit(1)).otherwise(F.lit(0)))
    ev = prefix_sum(ev, by, [sch.time], ["_lf", "_z"], out_prefix="_cum", slices=slices)
    s = F.when(F.col("_cum_z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_cum_lf")))
    return ev.select(*by, sch.time, F.col("n_at_risk").cast("bigint").alias("n_at_risk"),
                     F.col("d").cast("bigint").alias("d"), F.col("c").cast("bigint").alias("c"),
                     s.alias("s"))


def km_confidence(df: DataFrame, sch: SurvivalSchema = DEFAULT, by: Sequence[str] = (),
                  level: float = 0.95) -> DataFrame:
    """KM with a log(-log) Greenwood band (lifelines' default transform).

    var = sum d / (n (n - d)) over times <= t; the band is
    S ** exp(+-z sqrt(var) / ln S). Undefined (null) where S is 0 or 1.
    """
    by = list(by)
    km = kaplan_meier(df, sch, by)
    n = F.col("n_at_risk").cast("double")
    d = F.col("d").cast("double")
    km = km.withColumn("_g", F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0)))
    km = prefix_sum(km, by, [sch.time], ["_g"], out_prefix="_cum")
    z = _normal_quantile(0.5 + level / 2.0)
    s = F.col("s")
    ln_s = F.log(s)
    theta = F.lit(z) * F.sqrt(F.col("_cum_g")) / ln_s
    ok = (s > 0) & (s < 1)
    return km.select(*by, sch.time, "n_at_risk", "d", "c", "s",
                     F.when(ok, F.pow(s, F.exp(-theta))).alias("lower"),
                     F.when(ok, F.pow(s, F.exp(theta))).alias("upper"))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def grid_point(i: Column, T: Column, n_grid: int) -> Column:
    """g_i of ``linspace(0, T, n_grid)``: i * (T / (n_grid - 1)), last point exactly T."""
    step = T / F.lit(float(n_grid - 1))
    return F.when(i == n_grid - 1, T).otherwise(i.cast("double") * step)


def grid_cell(t: Column, T: Column, n_grid: int) -> Column:
    """Smallest grid index i with g_i >= t (t in [0, T]).

    ceil(t / step) can be one off in floating point, so it is corrected by
    comparing with the exact grid values -- the as-of rule stays exact.
    """
    step = T / F.lit(float(n_grid - 1))
    c0 = F.least(F.greatest(F.ceil(t / step).cast("int"), F.lit(0)), F.lit(n_grid - 1))
    c1 = F.when((c0 > 0) & (grid_point(c0 - 1, T, n_grid) >= t), c0 - 1).otherwise(c0)
    return F.when((c1 < n_grid - 1) & (grid_point(c1, T, n_grid) < t), c1 + 1).otherwise(c1)


def step_at(km: DataFrame, grid: DataFrame, by: Sequence[str], time: str = "time",
            n_grid: int = 500, value: str = "s", default: float = 1.0) -> DataFrame:
    """Evaluate a right-continuous step curve on a per-group linspace grid.

    ``grid`` has (by..., T); the result has (by..., i, g, value). As-of join
    without a range join: each step goes to the first grid cell at or after
    it, the cells aggregate to the last step (the minimum of a non-increasing
    curve), and a forward fill over the n_grid rows of a group carries it on.
    """
    by = list(by)
    steps = join_null_safe(km, grid.select(*by, "T"), by)
    steps = steps.where(F.col(time) <= F.col("T")) \
        .withColumn("i", grid_cell(F.col(time), F.col("T"), n_grid))
    cells = steps.groupBy(*by, "i").agg(F.max_by(F.col(value), F.col(time)).alias("_v"))
    pts = grid.select(*by, "T", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i"))
    pts = pts.withColumn("g", grid_point(F.col("i"), F.col("T"), n_grid))
    j = join_null_safe(pts, cells, [*by, "i"], "left")
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(float(default)))
    return j.select(*by, "i", "g", "T", filled.alias(value))


def survival_gap(real: DataFrame, syn: DataFrame, sch: SurvivalSchema = DEFAULT,
                 by: Sequence[str] = (), syn_keys: Sequence[str] = (),
                 n_grid: int = 500) -> DataFrame:
    """Optimism, KM divergence and short-sightedness per group.

    ``by`` groups both sides (e.g. a subgroup column); ``syn_keys`` are extra
    keys on the synthetic side only (e.g. ``method``), so one real curve is
    compared with every method in the same job. T = max(T_real, T_syn) over
    all rows (censored included); trapezoid rule on ``linspace(0, T, n_grid)``.
    Groups where a side is empty, or T <= 0, get nulls.
    """
    if not by:
        real = real.withColumn("_all", whole_table_key(sch.time))
        syn = syn.withColumn("_all", whole_table_key(sch.time))
        return survival_gap(real, syn, sch, ["_all"], syn_keys, n_grid).drop("_all")
    by, syn_keys = list(by), list(syn_keys)
    keys = syn_keys + by
    t = F.col(sch.time)
    r_max = real.groupBy(*by).agg(F.max(t).alias("T_real"))
    s_max = syn.groupBy(*keys).agg(F.max(t).alias("T_syn"))
    pairs = join_null_safe(s_max, r_max, by, "left")
    pairs = pairs.withColumn("T", F.greatest("T_real", "T_syn"))
    grid = pairs.where((F.col("T") > 0) & F.col("T_real").isNotNull() & F.col("T_syn").isNotNull()).select(*keys, "T")

    km_r = kaplan_meier(real, sch, by)
    km_s = kaplan_meier(syn, sch, keys)
    # real curve per (syn key, group): join on the group only; the real KM is
    # small (distinct times per group) and the grid side holds one row per key
    km_r_k = join_null_safe(grid.select(*keys), km_r, by, "inner")
    sr = step_at(km_r_k, grid, keys, sch.time, n_grid).withColumnRenamed("s", "s_real")
    ss = step_at(km_s, grid, keys, sch.time, n_grid).select(*keys, "i", F.col("s").alias("s_syn"))
    curve = join_null_safe(sr, ss, [*keys, "i"])
    w = Window.partitionBy(*keys).orderBy("i")
    diff = F.col("s_syn") - F.col("s_real")
    nxt_g = F.lead("g").over(w)
    nxt_d = F.lead(diff).over(w)
    nxt_a = F.lead(F.abs(diff)).over(w)
    seg = curve.select(*keys, "T",
                       ((nxt_g - F.col("g")) * (diff + nxt_d) / 2.0).alias("_o"),
                       ((nxt_g - F.col("g")) * (F.abs(diff) + nxt_a) / 2.0).alias("_k"))
    integ = seg.groupBy(*keys).agg((F.sum("_o") / F.first("T")).alias("optimism"),
                                   (F.sum("_k") / F.first("T")).alias("km_divergence"))
    short = F.when(F.col("T_real").isNull() | F.col("T_syn").isNull(), F.lit(None)).when(F.col("T_real") > 0,
                   F.greatest(F.lit(0.0), (F.col("T_real") - F.col("T_syn")) / F.col("T_real"))
                   ).otherwise(F.lit(0.0))
    return (pairs.select(*keys, "T_real", "T_syn", short.alias("short_sightedness"))
            .transform(lambda x: join_null_safe(x, integ, keys, "left"))
            .select(*keys, "optimism", "km_divergence", "short_sightedness"))


def event_rates(df: DataFrame, sch: SurvivalSchema = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """E5: n, event rate and censoring ratio per group."""
    s = F.col(sch.status).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                               F.avg(s).alias("event_rate"),
                               (F.lit(1.0) - F.avg(s)).alias("censoring_ratio"))


def event_rate_gap(real: DataFrame, syn: DataFrame, sch: SurvivalSchema = DEFAULT,
                   by: Sequence[str] = (), syn_keys: Sequence[str] = ()) -> DataFrame:
    """E5: |event rate real - event rate synthetic| per (syn key, group)."""
    if not by:
        real = real.withColumn("_all", whole_table_key(sch.time))
        syn = syn.withColumn("_all", whole_table_key(sch.time))
        return event_rate_gap(real, syn, sch, ["_all"], syn_keys).drop("_all")
    by, syn_keys = list(by), list(syn_keys)
    r = event_rates(real, sch, by).select(*by, F.col("event_rate").alias("real_event_rate"))
    s = event_rates(syn, sch, syn_keys + by).select(*syn_keys, *by, F.col("event_rate").alias("syn_event_rate"))
    j = join_null_safe(s, r, by)
    return j.withColumn("censoring_rate_diff", F.abs(F.col("real_event_rate") - F.col("syn_event_rate")))


# ---------------------------------------------------------------- E6 --------

def concordance(df: DataFrame, sch: SurvivalSchema = DEFAULT, score: str = "score",
                by: Sequence[str] = ()) -> DataFrame:
    """Harrell's C per group -- exact, O(n log n), no pairs materialised.

    A pair (i, j) is comparable when t_i < t_j and i had the event, or
    t_i == t_j and only i had the event (the event counts as earlier). It is
    concordant when the earlier one has the lower score (score = predicted
    survival, higher = longer); score ties count 1/2.

    Plan: rows collapse to weighted cells (time, score). Distinct times get a
    dense rank k (distributed prefix count). Pairs with k_i < k_j are counted
    by a merge-sort decomposition: at level l, parent = k >> l, and the
    left child's events (bit l-1 of k is 0) meet the right child's subjects
    (bit 1); each pair is met at exactly one level. Within a (level, parent)
    a descending running sum over score gives "subjects with a higher score"
    for every event cell. Same-time event/censored pairs use the same running
    sum keyed by time. Rows grow to n * log2(#times); every running sum is a
    range-partitioned ``prefix_sum``, so no group or time lands in one task.
    """
    if not by:
        out = concordance(df.withColumn("_all", whole_table_key(sch.time)), sch, score, ["_all"])
        return out.drop("_all")
    by = list(by)
    t, s = F.col(sch.time), F.col(score)
    e = F.col(sch.status).cast("long")
    clean = df.where(t.isNotNull() & s.isNotNull() & ~F.isnan(s.cast("double")))
    # written once: six branches read the cells, and what makes the scores (trees) is not run again for each
    cells = materialize(clean.groupBy(*by, sch.time, score).agg(
        F.sum(e).alias("ne"), F.sum(1 - e).alias("nc")), "cells")

    # dense time rank and "subjects strictly later" per distinct time
    times = cells.groupBy(*by, sch.time).agg(F.sum(F.col("ne") + F.col("nc")).alias("_nt"),
                                            F.sum("ne").alias("_et"), F.sum("nc").alias("_ct"))
    times = times.withColumn("_one", F.lit(1))
    times = prefix_sum(times, by, [sch.time], ["_one", "_nt"], out_prefix="_cum")
    tot = cells.groupBy(*by).agg(F.sum(F.col("ne") + F.col("nc")).alias("_N"))
    times = join_null_safe(times, tot, by)
    times = times.select(*by, sch.time, (F.col("_cum_one") - 1).cast("long").alias("_k"),
                         (F.col("_N") - F.col("_cum_nt")).alias("_later"),
                         (F.col("_et") * F.col("_ct")).alias("_same"))
    comp = times.groupBy(*by).agg(F.sum(F.col("_same")).alias("_c_same"))
    cells = join_null_safe(cells, times.select(*by, sch.time, "_k", "_later"), [*by, sch.time])
    comp_later = cells.groupBy(*by).agg(F.sum(F.col("ne") * F.col("_later")).alias("_c_later"))
    levels = cells.agg(F.max("_k").alias("m")).first()["m"]
    n_levels = max(1, int(levels or 0).bit_length())

    # pairs across distinct times, one merge level at a time (all levels in one plan)
    lv = cells.select(*by, "_k", score, "ne", "nc",
                      F.explode(F.sequence(F.lit(1), F.lit(n_levels))).alias("_lvl"))
    parent = F.expr("shiftright(_k, _lvl)")
    bit = F.expr("shiftright(_k, _lvl - 1) & 1")
    lv = lv.select(*by, "_lvl", parent.alias("_parent"), score,
                   F.when(bit == 0, F.col("ne")).otherwise(F.lit(0)).alias("_q"),
                   F.when(bit == 1, F.col("ne") + F.col("nc")).otherwise(F.lit(0)).alias("_w"))
    lv = lv.groupBy(*by, "_lvl", "_parent", score).agg(F.sum("_q").alias("_q"), F.sum("_w").alias("_w"))
    lv = lv.where((F.col("_q") > 0) | (F.col("_w") > 0))
    lv = prefix_sum(lv, [*by, "_lvl", "_parent"], [score], ["_w"], descending=True,
                    inclusive=False, out_prefix="_gt")  # -> _gt_w
    cross = lv.groupBy(*by).agg(F.sum(F.col("_q") * F.col("_gt_w")).alias("conc"),
                                F.sum(F.col("_q") * F.col("_w")).alias("tie"))

    # same time: events vs censored at that time
    st = prefix_sum(cells.select(*by, sch.time, score, "ne", "nc"), [*by, sch.time], [score], ["nc"],
                    descending=True, inclusive=False, out_prefix="_gt_")
    same = st.groupBy(*by).agg(F.sum(F.col("ne") * F.col("_gt_nc")).alias("conc"),
                               F.sum(F.col("ne") * F.col("nc")).alias("tie"))

    num = cross.unionByName(same).groupBy(*by).agg(F.sum("conc").alias("conc"), F.sum("tie").alias("tie"))
    j = join_null_safe(join_null_safe(comp_later, comp, by, "outer"), num, by, "left")
    n_comp = F.coalesce(F.col("_c_later"), F.lit(0)) + F.coalesce(F.col("_c_same"), F.lit(0))
    c_index = (F.coalesce(F.col("conc"), F.lit(0)) + 0.5 * F.coalesce(F.col("tie"), F.lit(0))) / n_comp
    return j.select(*by, n_comp.cast("bigint").alias("n_comparable"),
                    F.when(n_comp > 0, c_index.cast("double")).alias("c_index"))
