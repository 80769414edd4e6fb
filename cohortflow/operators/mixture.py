"""D2 fit: variational Bayesian mixture of normals, one for each column, all columns together.

The model is the truncated Dirichlet process mixture in one dimension: stick-breaking
weights with a small concentration, so that components the data does not need lose
their weight, and normal-gamma posteriors of mean and precision. The data enters
as counts per distinct value, written once; an iteration is one aggregation of
the responsibilities' sums (count, sum, sum of squares) by (column, component)
for all columns, and only these reach the driver. All rows are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.quantiles import grouped_quantiles
from cohortflow.session import materialize

#: Least variance of a component.
FLOOR = 1e-6


def digamma(x: float) -> float:
    """By recurrence to large arguments and the asymptotic series there."""
    shift = 0.0
    while x < 10.0:
        shift -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


class Posterior:
    """Posterior of one column: ``n``, ``mean`` and ``scatter`` (biased variance) of each component's rows."""

    def __init__(self, mean0: float, var0: float, concentration: float):
        self.mean0, self.var0, self.concentration = mean0, max(var0, FLOOR), concentration

    def update(self, n, mean, scatter) -> "Posterior":
        """Posterior parameters; the prior is one row at the column's mean with the column's variance."""
        k = len(n)
        self.a = [1.0 + v for v in n]
        self.b = [self.concentration + sum(n[j + 1 :]) for j in range(k)]
        self.beta = [1.0 + v for v in n]
        self.m = [(self.mean0 + v * x) / (1.0 + v) for v, x in zip(n, mean)]
        self.nu = [1.0 + v for v in n]
        self.var = [(self.var0 + v * s + v / (1.0 + v) * (x - self.mean0) ** 2) / nu for v, s, x, nu in zip(n, scatter, mean, self.nu)]
        self.var = [max(v, FLOOR) for v in self.var]
        return self

    def terms(self) -> list[tuple[float, float, float]]:
        """Per component (constant, mean, half the expected precision): ln rho = constant - half * (x - mean)^2."""
        out, rest = [], 0.0
        for a, b, beta, m, nu, var in zip(self.a, self.b, self.beta, self.m, self.nu, self.var):
            weight = digamma(a) - digamma(a + b) + rest
            rest += digamma(b) - digamma(a + b)
            precision = digamma(0.5 * nu) + math.log(2.0) - math.log(nu * var)  # expected log
            out.append((weight + 0.5 * precision - 0.5 / beta, m, 0.5 / var))
        return out

    def weights(self) -> list[float]:
        out, rest = [], 1.0
        for a, b in zip(self.a, self.b):
            out.append(rest * a / (a + b))
            rest *= b / (a + b)
        return [w / sum(out) for w in out]


def responsibilities(x, terms):
    """Shares of each value's components (values x components), and the log normaliser."""
    import numpy as np

    c, m, h = (np.array(v) for v in zip(*terms))
    rho = c[None, :] - h[None, :] * (x[:, None] - m[None, :]) ** 2
    top = rho.max(1, keepdims=True)
    e = np.exp(rho - top)
    total = e.sum(1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def fit(df: DataFrame, cols: Sequence[str], k: int = 10, max_iter: int = 100, tol: float = 1e-4,
        concentration: float = 1e-3) -> dict[str, Posterior]:
    """{column: posterior}; components start at the quantiles (j + 1/2) / k with equal shares.

    A column stops when its mean log normaliser moves by less than ``tol``; nulls and NaN are left
    out; a column without values has no posterior, one with fewer distinct values than ``k`` has as
    many components.
    """
    cols = list(cols)
    x = lambda c: F.col(f"`{c}`").cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), x(c).alias("v")) for c in cols])
    long = df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = materialize(long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), "mixture")
    stats = {r["column"]: r for r in counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean")).collect()}
    if not stats:
        return {}
    spread = {r["column"]: r["var"] for r in counts.join(F.broadcast(df.sparkSession.createDataFrame(
        [(c, float(r["mean"])) for c, r in stats.items()], "column string, mean double")), "column").groupBy("column").agg(
        (F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)) / F.sum("n")).alias("var")).collect()}  # a row a column
    starts = {r["column"]: list(r["q"]) for r in grouped_quantiles(counts, ["column"], [(j + 0.5) / k for j in range(k)], value="v", weight="n").collect()}
    found: dict[str, Posterior] = {}
    for c, r in stats.items():
        size = max(1, min(k, int(r["distinct"])))
        q = [starts[c][int((j + 0.5) * k / size)] for j in range(size)]
        share = float(r["n"]) / size
        found[c] = Posterior(float(r["mean"]), float(spread[c]), concentration).update([share] * size, q, [float(spread[c]) / size**2] * size)
    active, last = set(found), {}
    for _ in range(max_iter):
        if not active:
            break
        terms = {c: found[c].terms() for c in active}

        def sums(frames):
            import numpy as np

            total: dict = {}
            for f in frames:
                for c, part in f.groupby("column"):
                    v, n = part["v"].to_numpy(float), part["n"].to_numpy(float)
                    share, log = responsibilities(v, terms[c])  # noqa: B023
                    share = share * n[:, None]
                    away = v[:, None] - np.array([t[1] for t in terms[c]])[None, :]  # noqa: B023
                    add = np.array([share.sum(0), (share * away).sum(0), (share * away**2).sum(0)])
                    old = total.get(c, (0.0, 0.0))
                    total[c] = (old[0] + add, old[1] + float((log * n).sum()))
            rows = [(c, j, *s[:, j].tolist(), log if j == 0 else 0.0) for c, (s, log) in total.items() for j in range(s.shape[1])]
            yield pd.DataFrame(rows, columns=["column", "j", "s0", "s1", "s2", "log"])

        part = counts.where(F.col("column").isin(*active)).mapInPandas(sums, "column string, j int, s0 double, s1 double, s2 double, log double")
        by: dict = {}
        for r in part.groupBy("column", "j").agg(*[F.sum(s).alias(s) for s in ("s0", "s1", "s2", "log")]).collect():
            by.setdefault(r["column"], {})[r["j"]] = r
        for c in list(active):
            rows = [by[c][j] for j in sorted(by[c])]
            n = [max(r["s0"], 1e-10) for r in rows]
            off = [r["s1"] / v for r, v in zip(rows, n)]
            mean = [t[1] + o for t, o in zip(terms[c], off)]
            scatter = [max(r["s2"] / v - o * o, 0.0) for r, v, o in zip(rows, n, off)]
            found[c].update(n, mean, scatter)
            log = rows[0]["log"] / float(stats[c]["n"])
            if c in last and abs(log - last[c]) < tol:
                active.discard(c)
            last[c] = log
    return found
