"""The variational mixture against a plain numpy version, and what it is for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import encode, mixture


def plain(x, k, iters, concentration=1e-3):
    n, mean0, var0 = len(x), x.mean(), x.var()
    q = np.quantile(x, (np.arange(k) + 0.5) / k)
    p = mixture.Posterior(mean0, var0, concentration).update([n / k] * k, list(q), [var0 / k**2] * k)
    last = None
    for _ in range(iters):
        a, b, beta, m, nu, var = (np.array(v) for v in (p.a, p.b, p.beta, p.m, p.nu, p.var))
        dg = np.vectorize(mixture.digamma)
        stick = dg(a) - dg(a + b) + np.concatenate([[0], np.cumsum(dg(b) - dg(a + b))[:-1]])
        log = stick + 0.5 * (dg(nu / 2) + np.log(2) - np.log(nu * var)) - 0.5 / beta - 0.5 * (x[:, None] - m) ** 2 / var
        norm = np.logaddexp.reduce(log, axis=1)
        r = np.exp(log - norm[:, None])
        size = np.maximum(r.sum(0), 1e-10)
        mu = (r * x[:, None]).sum(0) / size
        p.update(list(size), list(mu), list(np.maximum((r * (x[:, None] - mu) ** 2).sum(0) / size, 0)))
        if last is not None and abs(norm.mean() - last) < 1e-4:
            break
        last = norm.mean()
    return p


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-4, 0.5, 200), rng.normal(3, 1.0, 300)]).round(3)
    y = rng.exponential(2.0, 500).round(2)
    rows = [(float(a), None if i % 90 == 0 else float(b), 7.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, one double").repartition(3)
    found = mixture.fit(df, ["x", "y", "one"], k=5, max_iter=40)
    for c, v in (("x", x), ("y", np.array([r[1] for r in rows if r[1] is not None]))):
        want = plain(v, 5, 40)
        assert np.allclose(found[c].m, want.m, atol=1e-6) and np.allclose(found[c].weights(), want.weights(), atol=1e-6)
        assert np.allclose(found[c].var, want.var, atol=1e-6)
    assert len(found["one"].m) == 1 and found["one"].m[0] == pytest.approx(7.0)


def test_unneeded_components_go(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-6, 0.5, 900), rng.normal(6, 0.5, 600)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    modes = encode.fit_modes(df, ["x"], k=6, max_iter=200).collect()
    heavy = sorted((r.mu, r.weight) for r in modes if r.weight > 0.02)
    assert sum(w for m, w in heavy if m < 0) == pytest.approx(0.6, abs=0.03) and all(abs(abs(m) - 6) < 1.5 for m, _ in heavy)
    back = encode.mode_decode(encode.mode_encode(df, encode.fit_modes(df, ["x"], k=6)), encode.fit_modes(df, ["x"], k=6))
    assert {c for c in back.columns} >= {"x"}
    assert mixture.fit(df.where("x > 100"), ["x"]) == {}


def test_digamma():
    assert mixture.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9) and mixture.digamma(0.5) == pytest.approx(-1.9635100260, abs=1e-9)
    assert mixture.digamma(100.5) == pytest.approx(np.log(100.0) + 1 / 2.4e5, abs=1e-6)
