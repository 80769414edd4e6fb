"""Batched boosting, batched Cox and the discrete-time hazard against plain versions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import boosting, cox, evaluate, models
from cohortflow.operators.hazard import DiscreteHazard, person_period_sums
from cohortflow.schema import DEFAULT
from test_models import _numpy_cox


def plain_boost(x, y, loss, trees, depth, rate, ridge, edges):
    """Boosting row by row and threshold by threshold."""
    base = float(y.mean()) if loss == "squared" else float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)

    def tree(rows, level, g, h):
        value = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        best = (1e-9, None, None)
        if level < depth:
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
            for j in range(x.shape[1]):
                for c in edges[j]:
                    left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if h[left].sum() < 1 - 1e-12 or h[right].sum() < 1 - 1e-12:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, left, right)
        if best[1] is None:
            raw[rows] += value
        else:
            tree(best[1], level + 1, g, h)
            tree(best[2], level + 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = (raw - y, np.ones(len(y))) if loss == "squared" else (p - y, p * (1 - p))
        tree(np.arange(len(y)), 0, g, h)
    return raw


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_grown_trees_equal_plain_boosting(loss):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = x[:, 0] - x[:, 1] ** 2 + rng.normal(size=150) * 0.2
    y = y if loss == "squared" else (y > -0.5).astype(float)
    edges = [(np.unique(x[:, j])[:-1] + np.unique(x[:, j])[1:]) / 2 for j in range(3)]
    m = boosting.grow(boosting.to_bins(x, edges), edges, y, loss, 6, 3, 0.3, 1.0, 1.0)
    assert np.allclose(m.raw(x), plain_boost(x, y, loss, 6, 3, 0.3, 1.0, edges), atol=1e-9)
    assert abs(m.importances.sum() - 1) < 1e-12


def cohort(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = rng.exponential(np.exp(0.8 * x[:, 0])) * 10 + 0.1
    c = rng.exponential(25, n)
    return [(i, float(min(a, b)), int(a <= b), float(u), None if i % 50 == 0 else float(v)) for i, (a, b, (u, v)) in enumerate(zip(t, c, x))]


SCHEMA = "patient_id long, time double, status int, x1 double, x2 double"


def test_many_fits_equal_single_fits(spark):
    a, b = (spark.createDataFrame(cohort(seed=s), SCHEMA) for s in (1, 2))
    both = a.withColumn("fit", F.lit("a")).unionByName(b.withColumn("fit", F.lit("b"))).repartition(5)
    many = boosting.fit_many(both, ["x1", "x2"], F.col("time"), F.col("fit"), F.col("patient_id"), trees=8)
    again = boosting.fit_many(both.repartition(2), ["x1", "x2"], F.col("time"), F.col("fit"), F.col("patient_id"), trees=8)
    one = boosting.predict(both, many, ["x1", "x2"], F.col("fit")).select("fit", "patient_id", "score")
    two = boosting.predict(both, again, ["x1", "x2"], F.col("fit")).select("fit", "patient_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.where("score is null").count() == 0
    assert boosting.predict(a, many, ["x1", "x2"], F.lit("c")).where("score is not null").count() == 0
    assert boosting.fit_many(a.limit(0), ["x1"], F.col("time"), F.lit("a"), F.col("patient_id")) == {}
    few = boosting.fit_many(both, ["x1", "x2"], F.col("time"), F.col("fit"), F.col("patient_id"), trees=2, max_rows=100)
    assert all(60 < m.n < 140 for m in few.values())


def test_as_good_as_the_library_trees(spark):
    from pyspark.ml.regression import GBTRegressor

    rows = [r for r in cohort(600, 4) if r[4] is not None]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", models.log_time(DEFAULT)).cache()
    learn, rest = df.where("patient_id % 3 != 0"), df.where("patient_id % 3 = 0")
    mine = models.predict_log_time(models.fit_log_time(learn, DEFAULT, ["x1", "x2"], trees=30, depth=3), rest, ["x1", "x2"])
    theirs = GBTRegressor(maxIter=30, maxDepth=3, stepSize=0.3, seed=0).fit(models._assemble(learn, ["x1", "x2"]))
    theirs = theirs.transform(models._assemble(rest, ["x1", "x2"]))
    error = lambda d, c: d.agg(F.avg(F.pow(F.col(c) - F.col("label"), 2))).first()[0]
    assert error(mine, "score") < 1.15 * error(theirs, "prediction")


def test_many_cox_fits_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for f, n in (("a", 150), ("b", 90), ("tied", 60)):
        x = rng.normal(size=(n, 2))
        t = np.round(rng.exponential(np.exp(-0.7 * x[:, 0])) * 10) + 1.0 if f != "tied" else np.full(n, 12.0)
        e = (rng.random(n) < 0.7).astype(int)
        want[f] = _numpy_cox(x, t, e, 0.01)
        rows += [(f, float(a), int(b), float(u), float(v)) for a, b, (u, v) in zip(t, e, x)]
    df = spark.createDataFrame(rows, "fit string, time double, status int, x1 double, x2 double").repartition(4)
    for size, block in ((65536, 4096), (20, 7)):
        monkeypatch.setattr(cox, "SLICE_ROWS", size)
        monkeypatch.setattr(cox, "TIE_BLOCK", block)
        got = cox.fit_many(df, DEFAULT, ["x1", "x2"], F.col("fit"), 0.01, tol=1e-10)
        assert got.keys() == want.keys() and all(np.allclose(got[f].beta, want[f], atol=1e-6) for f in want)


def test_hazard_equals_exploded_rows(spark):
    rows = [r for r in cohort(300, 7) if r[4] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    m = DiscreteHazard(12, tol=1e-9).fit(df, DEFAULT, ["x1", "x2"])
    x = np.array([r[3:5] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    ends = np.linspace(t.min(), t.max(), 12)
    last = np.searchsorted(ends, t)
    design, label = [], []
    for i in range(len(t)):
        for j in range(last[i] + 1):
            design.append(np.concatenate([np.eye(12)[j], z[i]]))
            label.append(float(e[i] and j == last[i]))
    design, label = np.array(design), np.array(label)
    common = np.log(label.sum() / (len(label) - label.sum()))
    prior = np.concatenate([np.full(12, common), np.zeros(2)])
    weight = np.concatenate([np.ones(12), np.full(2, 1e-6)])
    beta = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        g = design.T @ (label - p) - weight * (beta - prior)
        beta += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(weight), g)
    assert np.allclose(np.concatenate([m.a, m.b]), beta, atol=1e-5)
    s = np.array([r.surv for r in m.survival(df).orderBy("patient_id").collect()])
    want = np.cumprod(1 - 1 / (1 + np.exp(-(beta[None, :12] + (z @ beta[12:])[:, None]))), axis=1)
    assert np.allclose(s, want, atol=1e-5) and (np.diff(s, axis=1) <= 0).all()
    assert person_period_sums(z, last, e, m.a, m.b)[0] == pytest.approx(m.loglik)


def test_hazard_brier_no_worse_than_aft(spark):
    rows = [r for r in cohort(900, 9) if r[4] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    learn, rest = df.where("patient_id % 3 != 0"), df.where("patient_id % 3 = 0").cache()
    m = DiscreteHazard(40).fit(learn, DEFAULT, ["x1", "x2"])
    at = int(np.searchsorted(m.horizons, 6.0))
    h = float(m.horizons[at])
    curve = m.survival(rest).withColumn("p", F.col("surv")[at])
    aft = models.survival_curve(models.fit_aft(learn, DEFAULT, ["x1", "x2"]), rest, ["x1", "x2"], [h]).withColumn("p", F.col("surv")[0])
    assert evaluate.brier_at(curve, DEFAULT, "p", h) < 1.05 * evaluate.brier_at(aft, DEFAULT, "p", h)


def test_protocol_runs_for_real(spark):
    real = spark.createDataFrame([r for r in cohort(300, 3) if r[4] is not None], SCHEMA)
    test = spark.createDataFrame([r for r in cohort(120, 5) if r[4] is not None], SCHEMA)
    noise = real.withColumn("x1", F.col("x2")).withColumn("method", F.lit("noise"))
    syn = real.withColumn("method", F.lit("copy")).unionByName(noise)
    got = {(r.method, r.metric): r.value for r in evaluate.downstream(real, test, syn, DEFAULT, ["x1", "x2"], trees=True, tree_count=15, brier=True, on_train=True).collect()}
    assert len(got) == 2 * (2 * 5 + 4)
    for kind in ("cox", "xgb"):
        assert got["copy", f"custom.{kind}_trtr"] == got["noise", f"custom.{kind}_trtr"] == pytest.approx(got["copy", f"custom.{kind}_tstr"], abs=1e-9)
        assert got["copy", f"custom.{kind}_tstr"] > got["noise", f"custom.{kind}_tstr"]
    assert got["copy", "custom.brier_tstr_xgb"] < got["noise", "custom.brier_tstr_xgb"]


def test_time_to_event_runs_for_real(spark):
    df = spark.createDataFrame([r for r in cohort(300, 3) if r[4] is not None], SCHEMA).repartition(3)
    tte = models.TimeToEvent(points=10, trees=20, depth=3).fit(df, DEFAULT, ["x1", "x2"])
    one = tte.predict(df, F.col("status"), F.col("patient_id"), seed=1)
    two = tte.predict(df.repartition(2), F.col("status"), F.col("patient_id"), seed=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    lo, hi = df.agg(F.min("time"), F.max("time")).first()
    r = one.agg(F.min("pred_time"), F.max("pred_time"), F.corr(F.log("time"), F.log("pred_time"))).first()
    assert r[0] >= 0.5 * lo and r[1] <= 2 * hi and r[2] > 0.5
    kept = models.uncensor(one, DEFAULT).where("status = 1").select("patient_id", "time")
    assert kept.exceptAll(df.where("status = 1").select("patient_id", "time")).count() == 0
    status = models.predict_status(models.fit_censoring(df, DEFAULT, ["x1", "x2", "time"], trees=20), df, ["x1", "x2", "time"])
    assert {r.status for r in status.select("status").distinct().collect()} == {0, 1}
