"""Fidelity metrics between real and synthetic tables.

Every metric takes the real table and a synthetic table holding any number
of methods (``by=["method"]``), and returns one long table. Columns are
stacked with ``unpivot``/``explode`` so one grouped aggregation serves all
columns and all methods -- no Python loop over columns or methods.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe
from cohortflow.functions.quantiles import grouped_quantiles

from cohortflow.functions.windows import prefix_sum, slice_count
from cohortflow.operators.clean import nan_to_null
from cohortflow.schema import DEFAULT, SurvivalSchema
from cohortflow.session import materialize

#: Methods whose counts are columns of one running sum.
METHODS = 32


def stack(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(keys..., column, value) with every column cast to double; nulls dropped."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias(value))
                    for c in cols])
    return (df.select(*keys, F.explode(arr).alias("_kv")).select(*keys, "_kv.column", f"_kv.{value}")
            .where(F.col(value).isNotNull()))


def mean_comparison(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """per numeric column: real mean, synthetic mean, |diff| / (|real| + 1e-8) in %."""
    cols = [c for c in cols if c in real.columns and c in syn.columns]
    r = stack(real, cols).groupBy("column").agg(F.avg("value").alias("real_mean"))
    s = stack(syn, cols, by).groupBy(*by, "column").agg(F.avg("value").alias("syn_mean"))
    j = s.join(r, "column")
    return j.select(*by, "column", "real_mean", "syn_mean",
                    (F.abs(F.col("real_mean") - F.col("syn_mean")) / (F.abs(F.col("real_mean")) + 1e-8)
                     * 100.0).alias("rel_diff_pct"))


# ---------------------------------------------------------------- F1, F7 ----

def fit_bins(real: DataFrame, cols: Sequence[str], max_discrete: int = 20, n_bins: int = 10) -> DataFrame:
    """(column, discrete, lo, hi): a column with at most ``max_discrete``
    distinct real values is binned by value, else into ``n_bins`` equal-width
    bins over the real [min, max]. Distinct counts come from sketches first
    (``small_distinct_counts``); min/max from one aggregation."""
    cols = list(cols)
    vals = [nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]
    wide = real.select(*vals)
    # pass 1: sketches and ranges together; pass 2: exact counts near the limit only
    mm = wide.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"),
                             F.approx_count_distinct(c).alias("a")).alias(c) for c in cols]).first()
    small = [c for c in cols if mm[c]["a"] <= int(max_discrete * 1.5) + 10]
    nd = {c: None for c in cols}
    if small:
        ex = wide.agg(*[F.count_distinct(c).alias(c) for c in small]).first()
        nd.update({c: int(ex[c]) for c in small})
    rows = [(c, nd[c] is not None and nd[c] <= max_discrete, mm[c]["lo"], mm[c]["hi"]) for c in cols]
    return real.sparkSession.createDataFrame(rows, "column string, discrete boolean, lo double, hi double")


def bin_value(value: Column, discrete: Column, lo: Column, hi: Column, n_bins: int = 10) -> Column:
    """Bin id as double: the value itself (discrete) or a clamped equal-width bin."""
    span = hi - lo
    b = F.floor((value - lo) / span * n_bins)
    b = F.when(span <= 0, F.lit(0)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(n_bins - 1)))
    return F.when(discrete, value).otherwise(b.cast("double"))


def binned_frequencies(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                       max_discrete: int = 20, n_bins: int = 10) -> DataFrame:
    """(by..., column, bin, p_real, p_syn, n_real, n_syn) over the union of bins, 0-filled."""
    bins = F.broadcast(fit_bins(real, cols, max_discrete, n_bins))  # one row per column
    def counts(df, keys):
        s = stack(df, cols, keys).join(bins, "column")
        s = s.withColumn("bin", bin_value(F.col("value"), F.col("discrete"), F.col("lo"), F.col("hi"), n_bins))
        return s.groupBy(*keys, "column", "bin").agg(F.count(F.lit(1)).alias("n"))
    r = counts(real, []).withColumnRenamed("n", "_cr")
    s = counts(syn, list(by)).withColumnRenamed("n", "_cs")
    r_tot = r.groupBy("column").agg(F.sum("_cr").alias("n_real"))
    s_tot = s.groupBy(*by, "column").agg(F.sum("_cs").alias("n_syn"))
    keys = s_tot.select(*by, "column")
    r_k = r.join(keys, "column")  # real bins repeated once per (method, column) present
    j = r_k.join(s, [*by, "column", "bin"], "full_outer")
    j = j.join(r_tot, "column").join(s_tot, [*by, "column"])
    return j.select(*by, "column", "bin",
                    F.coalesce(F.col("_cr"), F.lit(0)).alias("c_real"),
                    F.coalesce(F.col("_cs"), F.lit(0)).alias("c_syn"), "n_real", "n_syn")


def jensen_shannon(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                   max_discrete: int = 20, n_bins: int = 10) -> DataFrame:
    """per (by, column): JS distance sqrt(JSD), natural log; bins from the real table."""
    f = binned_frequencies(real, syn, cols, by, max_discrete, n_bins)
    p = F.col("c_real") / F.col("n_real")
    q = F.col("c_syn") / F.col("n_syn")
    m = (p + q) / 2.0
    term = (F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)) / 2.0
    return (f.groupBy(*by, "column").agg(F.sum(term).alias("jsd"))
            .select(*by, "column", F.sqrt(F.greatest(F.col("jsd"), F.lit(0.0))).alias("js_distance")))


def inverse_kl(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
               max_discrete: int = 20, n_bins: int = 10) -> DataFrame:
    """per column 1 / (1 + KL(P_real || P_syn)) with add-one smoothing over the union of bins."""
    f = binned_frequencies(real, syn, cols, by, max_discrete, n_bins)
    k = F.count(F.lit(1)).over(Window.partitionBy(*by, "column"))
    f = f.withColumn("_k", k)
    p = (F.col("c_real") + 1.0) / (F.col("n_real") + F.col("_k"))
    q = (F.col("c_syn") + 1.0) / (F.col("n_syn") + F.col("_k"))
    return (f.groupBy(*by, "column").agg(F.sum(p * F.log(p / q)).alias("kl"))
            .select(*by, "column", (1.0 / (1.0 + F.col("kl"))).alias("inv_kl")))


# ---------------------------------------------------------------- F2-F4 -----

def wasserstein_1d(real: DataFrame, syn: DataFrame, groups: Sequence[str], value: str = "value",
                   by: Sequence[str] = ()) -> DataFrame:
    """Exact W1 = integral |F - G| per group, from weighted distinct values.

    ``groups`` key both sides (e.g. column, or status); ``by`` keys the
    synthetic side only (method). Values are grouped first, so the running
    sums run over distinct values with ``prefix_sum`` (no single task). A value
    is one row with a count for the real table and one for each of up to
    METHODS methods: real rows are neither repeated nor joined.
    """
    groups, by = list(groups), list(by)
    syn = syn.where(F.lit(True) if not by else reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in by]))
    found = [list(r) for r in syn.select(*by).distinct().orderBy(*by).collect()] if by else [[]]  # names of methods
    parts = [_wasserstein_of(real, syn, groups, value, by, found[at : at + METHODS]) for at in range(0, max(1, len(found)), METHODS)]
    return reduce(DataFrame.unionByName, parts)


def _wasserstein_of(real: DataFrame, syn: DataFrame, groups: list[str], value: str, by: list[str], methods: list[list]) -> DataFrame:
    """``wasserstein_1d`` of some methods (values of ``by``)."""
    mine = [reduce(lambda a, b: a & b, [F.col(b) == F.lit(v) for b, v in zip(by, m)], F.lit(True)) for m in methods]
    names = [f"_s{k}" for k in range(len(methods))]
    r = real.select(*groups, value, F.lit(1).alias("_r"), *[F.lit(0).alias(n) for n in names])
    s = syn.where(reduce(lambda a, b: a | b, mine, F.lit(False)))
    s = s.select(*groups, value, F.lit(0).alias("_r"), *[c.cast("int").alias(n) for c, n in zip(mine, names)])
    for g in groups:
        r, s = r.where(F.col(g).isNotNull()), s.where(F.col(g).isNotNull())
    u = r.unionByName(s).groupBy(*groups, value).agg(*[F.sum(n).alias(n) for n in ["_r", *names]])
    u = materialize(u, "values")
    tot = u.groupBy(*groups).agg(*[F.sum(n).alias(f"_N{n}") for n in ["_r", *names]])
    u = prefix_sum(u, groups, [value], ["_r", *names], out_prefix="_c", next_col="_next", slices=slice_count(u), written=True)
    u = u.join(tot, groups)
    width = F.col("_next") - F.col(value)
    gap = lambda n: F.abs(F.col("_c_r") / F.nullif(F.col("_N_r"), F.lit(0)) - F.col(f"_c{n}") / F.nullif(F.col(f"_N{n}"), F.lit(0))) * width
    sums = u.groupBy(*groups).agg(*[F.sum(gap(n)).alias(f"_w{n}") for n in names], *[F.first(f"_N{n}").alias(f"_N{n}") for n in ["_r", *names]])
    kinds = [syn.schema[b].dataType for b in by]
    one = [F.struct(*[F.lit(v).cast(t).alias(b) for b, v, t in zip(by, m, kinds)], F.col(f"_N{n}").alias("_n"),
                    F.when((F.col("_N_r") > 0) & (F.col(f"_N{n}") > 0), F.coalesce(F.col(f"_w{n}"), F.lit(0.0))).alias("w1"))
           for m, n in zip(methods, names)]
    kind = ", ".join([*[f"`{b}`:{t.simpleString()}" for b, t in zip(by, kinds)], "_n:bigint", "w1:double"])
    rows = sums.select(*groups, F.inline(F.array(*one).cast(f"array<struct<{kind}>>")))
    return rows.where(F.col("_n") > 0).select(*by, *groups, "w1")


def wasserstein_time(real: DataFrame, syn: DataFrame, sch: SurvivalSchema = DEFAULT,
                     by: Sequence[str] = ()) -> DataFrame:
    """W1 of time for events and for censored rows separately."""
    lab = F.when(F.col(sch.status) == 1, F.lit("event")).otherwise(F.lit("censor")).alias("subset")
    r = real.select(lab, F.col(sch.time).cast("double").alias("value"))
    s = syn.select(*by, lab, F.col(sch.time).cast("double").alias("value"))
    return wasserstein_1d(r, s, ["subset"], "value", by)


def minmax_params(real: DataFrame, cols: Sequence[str]) -> DataFrame:
    return stack(real, cols).groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _scaled(df: DataFrame, cols: Sequence[str], params: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = stack(df, cols, keys).join(F.broadcast(params), "column")
    span = F.col("hi") - F.col("lo")
    return s.select(*keys, "column", F.when(span > 0, (F.col("value") - F.col("lo")) / span)
                    .otherwise(F.lit(0.0)).alias("value"))


def wasserstein_columns(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F3 (re-aimed): per column W1 of min-max scaled values (real range); the
    mean over columns is the joint-distance proxy."""
    p = minmax_params(real, cols)
    return wasserstein_1d(_scaled(real, cols, p, []), _scaled(syn, cols, p, by), ["column"], "value", by)


def directions(n_cols: int, n: int = 16, seed: int = 0) -> list[list[float]]:
    """Seeded random unit vectors: parameters of the sliced distance."""
    import numpy as np

    d = np.random.default_rng(seed).normal(size=(n, n_cols))
    return (d / np.sqrt((d * d).sum(1, keepdims=True))).round(12).tolist()


def wasserstein_sliced(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (), n: int = 16,
                       seed: int = 0) -> DataFrame:
    """F3 (joint): per seeded direction the W1 of the projections of min-max scaled rows (real range;
    a null is the least value), all directions in one distributed W1. The mean over directions is
    the sliced joint distance."""
    cols = list(cols)
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in minmax_params(real, cols).collect()}  # a row a column

    def project(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        scaled = [F.coalesce((F.col(f"`{c}`").cast("double") - bounds[c][0]) / (bounds[c][1] - bounds[c][0]), F.lit(0.0))
                  if c in bounds and bounds[c][1] > bounds[c][0] else F.lit(0.0) for c in cols]
        values = []
        for d in directions(len(cols), n, seed):
            acc = F.lit(0.0)
            for x, w in zip(scaled, d):
                acc = acc + x * F.lit(w)
            values.append(acc)
        return df.select(*keys, F.posexplode(F.array(*values)).alias("direction", "value"))

    return wasserstein_1d(project(real, []), project(syn, by), ["direction"], "value", by)


def mmd_linear(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F4 (linear kernel): squared distance of the mean min-max scaled vectors."""
    p = minmax_params(real, cols)
    r = _scaled(real, cols, p, []).groupBy("column").agg(F.avg("value").alias("mr"))
    s = _scaled(syn, cols, p, by).groupBy(*by, "column").agg(F.avg("value").alias("ms"))
    j = s.join(r, "column")
    return j.groupBy(*by).agg(F.sum((F.col("ms") - F.col("mr")) ** 2).alias("mmd_linear"))


# ---------------------------------------------------------------- F18-F20 ---

def marginal_table(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                   max_discrete: int = 20, n_edges: int = 30) -> DataFrame:
    """categorical columns: normalised value counts per side over the
    union of categories (0-filled); continuous: density on ``n_edges - 1``
    equal bins between the pooled (real + that method) 1st and 99th
    percentile; values outside are left out, the last bin holds its right edge.
    """
    # each side is stacked once; all that follows reads counts of distinct values
    real_n = materialize(stack(real, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "marginal")
    syn_n = materialize(stack(syn, cols, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")), "marginal")
    disc = F.broadcast(real_n.groupBy("column").agg((F.count(F.lit(1)) <= max_discrete).alias("discrete")))  # a row per column
    rs = real_n.join(disc, "column")
    ss = syn_n.join(disc, "column")
    pairs = ss.select(*by, "column").distinct()
    pooled = rs.join(pairs, "column").select(*by, "column", "value", "discrete", "n").unionByName(
        ss.select(*by, "column", "value", "discrete", "n"))
    rng = grouped_quantiles(pooled.where(~F.col("discrete")), [*by, "column"], [0.01, 0.99], weight="n").select(
        *by, "column", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    nb = n_edges - 1

    def side(df, keys, name):
        d = df.where(F.col("discrete")).groupBy(*keys, "column", "value").agg(F.sum("n").alias("n"))
        d = d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "column")))
        d = d.select(*keys, "column", F.lit("value").alias("kind"), F.col("value").alias("x"), F.col("share").alias(name))
        c = df.where(~F.col("discrete")).join(rng, ["column"] if not keys else [*keys, "column"])
        w = (F.col("hi") - F.col("lo")) / nb
        b = F.floor((F.col("value") - F.col("lo")) / w)
        b = F.when(F.col("value") == F.col("hi"), F.lit(nb - 1)).otherwise(b)
        c = c.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")) & (F.col("hi") > F.col("lo")))
        c = c.withColumn("x", b.cast("double"))
        c = c.groupBy(*keys, "column", "x").agg(F.sum("n").alias("n"), F.first(w).alias("_w"))
        c = c.withColumn(name, F.col("n") / (F.sum("n").over(Window.partitionBy(*keys, "column")) * F.col("_w")))
        c = c.select(*keys, "column", F.lit("bin").alias("kind"), "x", name)
        return d.unionByName(c)

    r = side(rs.join(pairs, "column"), list(by), "real") if by else side(rs, [], "real")
    s = side(ss, list(by), "syn")
    j = r.join(s, [*by, "column", "kind", "x"], "full_outer")
    return j.select(*by, "column", "kind", "x", F.coalesce("real", F.lit(0.0)).alias("real"),
                    F.coalesce("syn", F.lit(0.0)).alias("syn"))


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``np.histogram(values, bins)`` over [lo, hi]: equal width, the
    last bin holds hi; floating edge cases corrected against the exact edges."""
    step = (hi - lo) / F.lit(float(bins))
    edge = lambda i: F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)
    i0 = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i0 = F.least(F.greatest(i0, F.lit(0)), F.lit(bins - 1))
    i1 = F.when((i0 > 0) & (x < edge(i0)), i0 - 1).otherwise(i0)
    i2 = F.when((i1 < bins - 1) & (x >= edge(i1 + 1)), i1 + 1).otherwise(i1)
    return F.when(hi == lo, F.lit(0)).otherwise(i2)


def time_histogram(df: DataFrame, sch: SurvivalSchema = DEFAULT, by: Sequence[str] = (),
                   bins: int = 15) -> DataFrame:
    """equal-width counts over each table's own [min, max]."""
    t = F.col(sch.time).cast("double")
    rng = df.groupBy(*by).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    if by:
        j = join_null_safe(df.select(*by, t.alias("_t")), rng, by)
    else:  # one row of bounds: literals, no join
        r = rng.first()
        j = df.select(t.alias("_t"), F.lit(r["lo"]).cast("double").alias("lo"), F.lit(r["hi"]).cast("double").alias("hi"))
    j = j.withColumn("bin", histogram_bin(F.col("_t"), F.col("lo"), F.col("hi"), bins))
    out = j.groupBy(*by, "bin").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                    F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / float(bins)
    return out.select(*by, "bin", (F.col("bin") * step + F.col("lo")).alias("left_edge"), "n")


#: Distinct (group, value) pairs of a column whose ranks are sent to every task.
RANKS_SENT = 100_000


def value_ranks(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, rank), written: the average rank of every distinct value.

    Per (by, column, value): count; an exclusive running count (prefix_sum)
    gives rank_min - 1; average = before + (count + 1) / 2.
    """
    v = stack(df, cols, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
    v = prefix_sum(v, [*by, "column"], ["value"], ["_n"], inclusive=False, out_prefix="_before")
    return materialize(v.select(*by, "column", "value", (F.col("_before_n") + (F.col("_n") + 1) / 2.0).alias("rank")), "ranks")


def average_ranks(df: DataFrame, cols: Sequence[str], row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., row_id, a rank for each column) with ties given their average rank; null for null.

    Rows stay whole: a column's ranks are joined by value, sent to every task for a
    column of few values, so that only columns of many values shuffle the rows.
    """
    cols, by = list(cols), list(by)
    ranks = value_ranks(df, cols, by)
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}  # a row per column
    out = df.select(*by, row_id, *[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"_v{j}") for j, c in enumerate(cols)])
    for b in by:
        out = out.where(F.col(b).isNotNull())
    out = out.where(F.coalesce(*[F.col(f"_v{j}") for j in range(len(cols))]).isNotNull())
    for j, c in sorted(enumerate(cols), key=lambda jc: -sizes.get(jc[1], 0)):
        r = ranks.where(F.col("column") == c).select(*by, F.col("value").alias(f"_v{j}"), F.col("rank").alias(f"_r{j}"))
        out = out.join(F.broadcast(r) if sizes.get(c, 0) <= RANKS_SENT else r, [*by, f"_v{j}"], "left").drop(f"_v{j}")
    return out.select(*by, row_id, *[F.col(f"_r{j}").alias(c) for j, c in enumerate(cols)])


def spearman_panel(df: DataFrame, cols: Sequence[str], row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman rho for every column pair (Pearson on average ranks).

    One aggregation holds the means, squares and products of all pairs
    (C <= 25 columns), and only its one row per group is unfolded into pairs.
    """
    cols = list(cols)
    wide = average_ranks(df, cols, row_id, by)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sums = wide.groupBy(*by).agg(*[pearson(a, b).alias(f"_p{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"_p{k}").alias("rho"))
                      for k, (a, b) in enumerate(pairs)])
    return sums.select(*by, F.inline(cells))


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant
    (``corr`` raises on a zero variance under ANSI mode)."""
    mx, my = F.avg(x), F.avg(y)
    sxy = F.avg(F.col(x) * F.col(y)) - mx * my
    sxx = F.avg(F.col(x) * F.col(x)) - mx * mx
    syy = F.avg(F.col(y) * F.col(y)) - my * my
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def rff_params(n_cols: int, n_features: int = 128, sigma: float = 0.5, seed: int = 0):
    """Random Fourier features of an RBF kernel exp(-|x - y|^2 / (2 sigma^2)):
    W ~ N(0, 1 / sigma^2), b ~ U(0, 2 pi). Seeded numpy draws, a parameter."""
    import numpy as np

    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, 1.0 / sigma, size=(n_features, n_cols))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_features)
    return [[float(v) for v in row] for row in W], [float(v) for v in b]


def mmd_rbf(real: DataFrame, syn: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
            n_features: int = 128, sigma: float = 0.5, seed: int = 0) -> DataFrame:
    """F4 (RBF kernel, any scale): squared distance between the mean random
    Fourier feature vectors of the two tables, on min-max scaled columns.
    Each side is one aggregation of ``n_features`` averages (partial + final),
    so the cost is linear in rows -- no pairs."""
    import math

    cols = list(cols)
    p = {r["column"]: (r["lo"], r["hi"]) for r in minmax_params(real, cols).collect()}
    W, b = rff_params(len(cols), n_features, sigma, seed)

    def scaled(c):
        lo, hi = p[c]
        return (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)

    xs = [scaled(c) for c in cols]
    feats = []
    for k in range(n_features):
        z = F.lit(W[k][0]) * xs[0]
        for j in range(1, len(cols)):
            z = z + F.lit(W[k][j]) * xs[j]
        feats.append(F.avg(F.cos(z + F.lit(b[k]))).alias(f"f{k}"))
    names = [f"f{k}" for k in range(n_features)]
    r = real.agg(*feats).unpivot([], names, "k", "mr")
    s = syn.groupBy(*by).agg(*feats).unpivot(list(by), names, "k", "ms")
    scale = 2.0 / n_features
    return (s.join(r, "k").groupBy(*by)
            .agg((F.sum((F.col("ms") - F.col("mr")) * (F.col("ms") - F.col("mr"))) * scale).alias("mmd_rbf")))
