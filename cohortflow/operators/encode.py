"""Tabular encoders (D1-D9): mode-specific normalisation, one-hot, bins.

Fitting returns small parameter tables; encoding and decoding are plain
column expressions built from them (argmax over a handful of components),
so they run in whole-stage codegen with no UDF and no Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.quantiles import column_quantiles

from cohortflow.operators.clean import nan_to_null
from cohortflow.operators.fidelity import stack
from cohortflow.schema import DEFAULT, SurvivalSchema

SIGMA_FLOOR = 1e-6
WEIGHT_FLOOR = 1e-3


def discrete_columns(df: DataFrame, cols: Sequence[str], limit: int = 10) -> DataFrame:
    """(column, n_distinct, is_discrete); ``n_distinct`` is exact for the
    discrete numeric columns and null for columns ruled out by their sketch.
    Text and boolean columns are always discrete; their ``n_distinct`` is
    given up to ``limit`` and null beyond it."""
    from cohortflow.functions.exprs import small_distinct_counts
    from cohortflow.operators.clean import is_numeric

    cols = list(cols)
    numeric = {c for c in cols if is_numeric(df, c)}
    nd = small_distinct_counts(df.select(*[(nan_to_null(F.col(c).cast("double")) if c in numeric
                                            else F.col(c).cast("string")).alias(c) for c in cols]),
                               cols, limit)
    few = {c: nd[c] is not None and nd[c] <= limit for c in cols}
    rows = [(c, nd[c] if few[c] else None, few[c] or c not in numeric) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct bigint, is_discrete boolean")


def time_horizons(df: DataFrame, sch: SurvivalSchema = DEFAULT, m: int = 100) -> DataFrame:
    """M equally spaced times over [min, max] (linspace; last point exact)."""
    b = df.agg(F.min(sch.time).alias("lo"), F.max(sch.time).alias("hi"))
    x = b.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    step = (F.col("hi") - F.col("lo")) / float(m - 1)
    h = F.when(F.col("i") == m - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i").cast("double") * step)
    return x.select("i", h.alias("horizon"))


# ------------------------------------------------------------------ D2/D3 ----

def init_modes(train: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Deterministic k-mode parameters: means at the (j + 0.5)/k quantiles,
    sigma = (q90 - q10) / (2k) (floored), equal weights. Used as the EM start
    and as a fixed parameter table where an exact oracle is needed."""
    qs = [(j + 0.5) / k for j in range(k)] + [0.1, 0.9]
    st = column_quantiles(train, cols, qs)
    comps = F.array(*[F.struct(F.lit(j).alias("comp"), F.col("q")[j].alias("mu")) for j in range(k)])
    sig = F.greatest((F.col("q")[k + 1] - F.col("q")[k]) / (2.0 * k), F.lit(SIGMA_FLOOR))
    return st.select("column", F.explode(comps).alias("c"), sig.alias("sigma")).select(
        "column", F.col("c.comp").cast("int").alias("comp"), F.lit(1.0 / k).alias("weight"),
        F.col("c.mu").alias("mu"), "sigma")


def fit_modes(train: DataFrame, cols: Sequence[str], k: int = 10, max_iter: int = 100,
              seed: int = 0) -> DataFrame:
    """D2 fit: a variational Bayesian mixture per column (``mixture.fit``), all columns in
    one aggregation an iteration.

    The small concentration of the weights switches off unneeded components; those of
    weight under ``WEIGHT_FLOOR`` are dropped and the rest numbered from 0. Only k (weight,
    mu, sigma) triples per column reach the driver. ``seed`` is not used: the fit starts
    at quantiles and is deterministic.
    """
    from cohortflow.operators import mixture

    found = mixture.fit(train, cols, k, max_iter)
    out = []
    for c in cols:
        if c not in found:
            continue
        p = found[c]
        kept = [(w, m, max(math.sqrt(v), SIGMA_FLOOR)) for w, m, v in zip(p.weights(), p.m, p.var) if w >= WEIGHT_FLOOR]
        out += [(c, j, float(w), float(m), float(s)) for j, (w, m, s) in enumerate(kept)]
    return train.sparkSession.createDataFrame(out, "column string, comp int, weight double, mu double, sigma double")


def _params(params: DataFrame) -> dict[str, list[tuple[int, float, float, float]]]:
    p: dict[str, list] = {}
    for r in params.orderBy("column", "comp").collect():
        p.setdefault(r["column"], []).append((r["comp"], r["weight"], r["mu"], r["sigma"]))
    return p


def _argmax(values: list[Column]) -> Column:
    """0-based position of the largest value, first on ties (numpy's argmax).

    Built on an array so the expression stays linear in the number of values."""
    arr = F.array(*values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def _argmax_comp(x: Column, comps) -> Column:
    """Most probable component: argmax of ln w - ln sigma - (x - mu)^2 / (2 sigma^2)."""
    scores = [F.lit(math.log(w) - math.log(sd)) - (x - F.lit(mu)) ** 2 / F.lit(2.0 * sd * sd)
              for _, w, mu, sd in comps]
    ids = F.array(*[F.lit(j) for j, *_ in comps])
    return F.element_at(ids, _argmax(scores) + 1)


def _pick(comp: Column, comps, idx: int) -> Column:
    """Parameter ``idx`` (2 = mu, 3 = sigma) of component ``comp``."""
    pos = {t[0]: i for i, t in enumerate(comps)}
    if all(pos[j] == j for j in pos):
        return F.element_at(F.array(*[F.lit(t[idx]) for t in comps]), comp + 1)
    e = None
    for t in comps:
        e = (F.when(comp == t[0], F.lit(t[idx])) if e is None else e.when(comp == t[0], F.lit(t[idx])))
    return e


def mode_encode(df: DataFrame, params: DataFrame, cols: Sequence[str] | None = None,
                one_hot: bool = True) -> DataFrame:
    """D2 transform: per column ``<c>__norm`` in [0, 1] and ``<c>__comp`` (plus
    one-hot ``<c>__comp_j``): (x - mu) / (4 sigma) clipped to +-0.99, mapped to [0, 1]."""
    p = _params(params)
    cols = [c for c in (cols or list(p)) if c in df.columns and c in p]
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        comp = _argmax_comp(x, p[c])
        out = out.withColumn(f"{c}__comp", comp)
        cc = F.col(f"{c}__comp")
        mu, sd = _pick(cc, p[c], 2), _pick(cc, p[c], 3)
        z = (x - mu) / (4.0 * sd)
        z = F.when(z < -0.99, -0.99).when(z > 0.99, 0.99).otherwise(z)
        out = out.withColumn(f"{c}__norm", (z + 1.0) / 2.0)
        if one_hot:
            for j, *_ in p[c]:
                out = out.withColumn(f"{c}__comp_{j}", (cc == j).cast("double"))
    return out


def mode_decode(df: DataFrame, params: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D3: component from the one-hot (argmax, first on ties) or ``__comp``;
    x = (2 norm - 1) 4 sigma + mu."""
    p = _params(params)
    cols = [c for c in (cols or list(p)) if c in p and f"{c}__norm" in df.columns]
    out = df
    for c in cols:
        hot = [f"{c}__comp_{j}" for j, *_ in p[c] if f"{c}__comp_{j}" in df.columns]
        if hot and len(hot) == len(p[c]):
            ids = F.array(*[F.lit(j) for j, *_ in p[c]])
            comp = F.element_at(ids, _argmax([F.col(h) for h in hot]) + 1)
        else:
            comp = F.col(f"{c}__comp")
        v = F.col(f"{c}__norm") * 2.0 - 1.0
        out = out.withColumn(c, v * (4.0 * _pick(comp, p[c], 3)) + _pick(comp, p[c], 2))
    return out


# ------------------------------------------------------------------ D4 -------

def fit_categories(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D4 fit: (column, value) sorted categories, as text."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (train.select(F.explode(arr).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
            .distinct())


def _cats(cats: DataFrame) -> dict[str, list[str]]:
    d: dict[str, list[str]] = {}
    for r in cats.collect():
        d.setdefault(r["column"], []).append(r["value"])
    for k in d:
        try:
            d[k].sort(key=float)
        except ValueError:
            d[k].sort()
    return d


def one_hot_layout(cats: DataFrame) -> list[tuple[str, int, str]]:
    """(column, position, value): output column ``<column>__<position>`` holds value."""
    return [(c, i, v) for c, vals in _cats(cats).items() for i, v in enumerate(vals)]


def one_hot(df: DataFrame, cats: DataFrame) -> DataFrame:
    """``<c>__<i>`` 0/1 columns for the i-th sorted category; an unseen
    value is all zeros."""
    exprs = [F.col(c) for c in df.columns]
    for c, i, v in one_hot_layout(cats):
        if c in df.columns:
            exprs.append((F.col(c).cast("string") == v).cast("int").alias(f"{c}__{i}"))
    return df.select(*exprs)


def one_hot_decode(df: DataFrame, cats: DataFrame) -> DataFrame:
    """D4 inverse: the category of the largest indicator (first on ties);
    all zeros -> the first category, like an argmax."""
    d = _cats(cats)
    out = df
    for c, vals in d.items():
        pos = _argmax([F.col(f"{c}__{i}") for i in range(len(vals))])
        out = out.withColumn(c, F.element_at(F.array(*[F.lit(v) for v in vals]), pos + 1))
    return out


# ------------------------------------------------------------------ D5-D7 ----

@dataclass
class TabularEncoder:
    """One-hot for columns with <= ``limit`` distinct values, mode-specific
    normalisation (k modes) for the rest; ``inverse`` restores integer columns
    by rounding half-even before the cast."""

    k: int = 10
    limit: int = 10
    fitted: bool = False
    discrete: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    int_cols: list[str] = field(default_factory=list)
    cats: DataFrame | None = None
    modes: DataFrame | None = None

    def fit(self, df: DataFrame, cols: Sequence[str], modes: DataFrame | None = None) -> "TabularEncoder":
        d = {r["column"]: r["is_discrete"] for r in discrete_columns(df, cols, self.limit).collect()}
        self.discrete = [c for c in cols if d.get(c)]
        self.continuous = [c for c in cols if not d.get(c)]
        self.int_cols = [c for c in cols if df.schema[c].dataType.simpleString() in ("bigint", "int")]
        self.cats = fit_categories(df, self.discrete) if self.discrete else None
        if modes is not None:
            self.modes = modes
        elif self.continuous:
            self.modes = fit_modes(df, self.continuous, self.k)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        if self.cats is not None:
            out = one_hot(out, self.cats)
        if self.modes is not None:
            out = mode_encode(out, self.modes, self.continuous)
        return out.drop(*self.discrete, *self.continuous)

    def inverse(self, enc: DataFrame) -> DataFrame:
        out = enc
        if self.cats is not None:
            out = one_hot_decode(out, self.cats)
        if self.modes is not None:
            out = mode_decode(out, self.modes, self.continuous)
        for c in self.int_cols:
            if c in out.columns:
                out = out.withColumn(c, F.bround(F.col(c).cast("double"), 0).cast("long"))
        keep = [c for c in out.columns if "__" not in c]
        return out.select(*keep)


def bin_encode(df: DataFrame, params: DataFrame, continuous: Sequence[str]) -> DataFrame:
    """Continuous columns -> index of the most probable of (usually 2) modes;
    discrete columns pass through."""
    p = _params(params)
    return df.select(*[(_argmax_comp(F.col(c).cast("double"), p[c]).alias(c) if c in continuous and c in p
                        else F.col(c)) for c in df.columns])


def survival_condition(df: DataFrame, params: DataFrame, continuous: Sequence[str],
                       cols: Sequence[str], key: str) -> DataFrame:
    """Bin-encode [time, status, covariates] and express every cell as a
    (key, feature, level) long table -- the one-hot positions of the
    condition vector -- plus a ``cell`` string usable as a grouping key."""
    b = bin_encode(df.select(key, *cols), params, continuous)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("level")) for c in cols])
    cell = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return b.select(key, cell.alias("cell"), F.explode(arr).alias("x")).select(key, "cell", "x.feature", "x.level")
