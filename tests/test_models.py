"""Cox partial likelihood (Efron ties, ridge) against a direct numpy Newton."""

import numpy as np
import pytest

from cohortflow.operators import cox, models, survival
from cohortflow.schema import DEFAULT


def _numpy_cox(X, t, e, lam, iters=50):
    n, k = X.shape
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    b = np.zeros(k)

    def parts(b):
        eta = Z @ b
        r = np.exp(eta)
        ll, g, H = 0.0, np.zeros(k), np.zeros((k, k))
        for tt in np.unique(t[e == 1]):
            D = (t == tt) & (e == 1)
            R = t >= tt
            d = D.sum()
            s0r, s1r, s2r = r[R].sum(), (Z[R] * r[R, None]).sum(0), (Z[R].T * r[R]) @ Z[R]
            s0d, s1d, s2d = r[D].sum(), (Z[D] * r[D, None]).sum(0), (Z[D].T * r[D]) @ Z[D]
            ll += eta[D].sum()
            g += Z[D].sum(0)
            for l in range(d):
                f = l / d
                den = s0r - f * s0d
                n1 = s1r - f * s1d
                n2 = s2r - f * s2d
                ll -= np.log(den)
                g -= n1 / den
                H -= n2 / den - np.outer(n1, n1) / den ** 2
        return ll / n - 0.5 * lam * b @ b, g / n - lam * b, H / n - lam * np.eye(k)

    for _ in range(iters):
        ll, g, H = parts(b)
        step = np.linalg.solve(H, g)
        b = b - step
        if np.max(np.abs(step)) < 1e-10:
            break
    return b


def test_cox_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 160
    X = rng.normal(size=(n, 2))
    t = np.round(rng.exponential(np.exp(-0.7 * X[:, 0] + 0.3 * X[:, 1])) * 10) + 1.0  # many ties
    e = (rng.random(n) < 0.7).astype(int)
    want = _numpy_cox(X, t, e, 0.01)
    df = spark.createDataFrame([(float(t[i]), int(e[i]), float(X[i, 0]), float(X[i, 1])) for i in range(n)],
                               "time double, status int, x1 double, x2 double")
    cox = models.CoxPH(penalizer=0.01, tol=1e-10).fit(df, DEFAULT, ["x1", "x2"])
    assert np.allclose(cox.beta, want, atol=1e-6)
    c = survival.concordance(cox.score(df), DEFAULT, "score").first().c_index
    assert c > 0.6


def test_cox_ties_over_several_blocks(spark, monkeypatch):
    """Blocks of tied positions give the coefficients of one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    t = np.ceil(rng.exponential(np.exp(-0.5 * x)) * 3)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(t, rng.random(400) < 0.8, x)]
    df = spark.createDataFrame(rows, "time double, status int, x double").cache()
    whole = models.CoxPH(penalizer=0.01).fit(df, DEFAULT, ["x"]).beta
    monkeypatch.setattr(cox, "TIE_BLOCK", 7)
    assert models.CoxPH(penalizer=0.01).fit(df, DEFAULT, ["x"]).beta == pytest.approx(whole, abs=1e-9)
