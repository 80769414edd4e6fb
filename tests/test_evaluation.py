"""The metric tiers run for real on a small table; joint distance, clusters and replicates against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import evaluate, fidelity, neighbours, privacy
from cohortflow.schema import DEFAULT

COLS = ["age", "sex", "ancestry", "cancer_type"]
SCHEMA = "patient_id long, time double, status int, age double, sex long, ancestry long, cancer_type long"


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.exponential(20) + 0.1), int(rng.random() < 0.6), float(rng.integers(30, 40)), int(rng.integers(2)), int(rng.integers(2)),
             int(rng.integers(3))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    real, test = table(spark, 130, 1), table(spark, 60, 2)
    flat = table(spark, 100, 4).withColumn("time", F.lit(5.0)).withColumn("method", F.lit("flat"))
    syn = real.where("patient_id % 2 = 0").withColumn("method", F.lit("half")).unionByName(table(spark, 140, 3).withColumn("method", F.lit("other")))
    return real.cache(), test.cache(), syn.unionByName(flat).cache()


def rows_of(df):
    return {(r.method, r.vs, r.metric): r.value for r in df.collect()}


def test_tiers_run_whole_and_resume(spark, tables, tmp_path, monkeypatch):
    real, test, syn = tables
    args = dict(heavy_n_sub=40, heavy_n_bootstrap=2, priv=True)
    folder = f"file://{tmp_path}/metrics"

    def lost(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the first run dies in some metrics
        m.setattr(fidelity, "inverse_kl", lost)
        m.setattr(evaluate, "detection_auc", lost)
        broken = evaluate.evaluate_methods(real, test, syn, DEFAULT, COLS, save_dir=folder, **args).collect()
    assert {r.metric for r in broken if r.error} == {"detection.detection_xgb.mean", "detection.detection_mlp.mean", "stats.inv_kl_divergence.marginal.mean"}
    with monkeypatch.context() as m:  # what was finished is not run again
        m.setattr(evaluate, "downstream", lost)
        m.setattr(fidelity, "jensen_shannon", lost)
        m.setattr(neighbours, "replicates", lost)
        got = evaluate.evaluate_methods(real, test, syn, DEFAULT, COLS, save_dir=folder, **args)
        assert got.where("error IS NOT NULL").count() == 0
        found = rows_of(got)
    assert {k for k in found if k[0] == "flat"} == {("flat", "train", "preflight.passed")} and found["flat", "train", "preflight.passed"] == 0
    for vs in ("train", "test"):
        for name in ("custom.optimism", "custom.censoring_rate_diff", "stats.jensenshannon_dist.marginal.mean", "detection.detection_xgb.mean",
                     "detection.detection_mlp.mean", "performance.feat_rank_distance.corr", "performance.xgb.xgb_tstr", "performance.xgb.brier_tstr",
                     "performance.linear_model.cox_tstr", "performance.linear_model.brier_tstr_aft", "stats.max_mean_discrepancy.linear",
                     "stats.max_mean_discrepancy.joint.mean", "stats.wasserstein_dist.joint", "stats.prdc.precision.boot_std",
                     "stats.alpha_precision.authenticity_naive.mean", "stats.inv_kl_divergence.marginal.mean"):
            assert ("half", vs, name) in found and ("other", vs, name) in found, (vs, name)
    for name in ("privacy.k-anonymization", "privacy.l-diversity", "privacy.k-anonymization.clusters", "privacy.identifiability_score"):
        assert ("half", "train", name) in found
    assert found["half", "train", "stats.prdc.precision.boot_n"] == 2


def test_sizes_are_matched_for_each_method(spark, tables):
    real, _, syn = tables
    sizes = {}
    for a, b in evaluate.matched_pairs(real, syn, "patient_id", 42):
        for r in b.groupBy("method").count().collect():
            sizes[r.method] = (a.count(), r["count"])
    assert sizes == {"half": (65, 65), "other": (130, 130), "flat": (100, 100)}
    same = evaluate.matched_pairs(real, real.withColumn("method", F.lit("m")), "patient_id", 42)
    assert len(same) == 1 and same[0][0] is real


def test_sliced_distance(spark, tables):
    real, _, syn = tables
    got = {(r.method, r.direction): r.w1 for r in fidelity.wasserstein_sliced(real, syn, ["age", "time"], ["method"], n=3, seed=5).collect()}
    x = real.select("age", "time").toPandas().to_numpy()
    lo, hi = x.min(0), x.max(0)
    for j, d in enumerate(fidelity.directions(2, 3, 5)):
        assert np.linalg.norm(d) == pytest.approx(1)
        a = np.sort(((x - lo) / (hi - lo)) @ d)
        for m in ("half", "other", "flat"):
            y = syn.where(F.col("method") == m).select("age", "time").toPandas().to_numpy()
            b = np.sort(((y - lo) / (hi - lo)) @ d)
            at = np.sort(np.concatenate([a, b]))
            gap = np.abs(np.searchsorted(a, at[:-1], "right") / len(a) - np.searchsorted(b, at[:-1], "right") / len(b))
            assert got[m, j] == pytest.approx((gap * np.diff(at)).sum(), abs=1e-9)


def test_clusters_equal_numpy(spark, tables):
    _, _, syn = tables
    got = {r.method: (r.k_anonymity, r.l_diversity) for r in privacy.cluster_privacy(syn.repartition(3), ["age", "time"], "cancer_type", clusters=(2, 5)).collect()}
    assert got == {r.method: (r.k_anonymity, r.l_diversity) for r in privacy.cluster_privacy(syn.coalesce(1), ["age", "time"], "cancer_type", clusters=(2, 5)).collect()}
    import hashlib

    for m in ("half", "other"):
        rows = syn.where(F.col("method") == m).collect()
        x = np.array([[r.age, r.time] for r in rows])
        x = (x - x.min(0)) / (x.max(0) - x.min(0))
        h = [int(hashlib.md5(f"{r.patient_id}|cluster|0".encode()).hexdigest()[:8], 16) for r in rows]
        order = sorted(range(len(x)), key=lambda i: (h[i], tuple(x[i])))
        best = (10**9, 10**9)
        for k in (2, 5):
            c = x[order[:k]]
            for _ in range(20):
                at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            cells = [[rows[i].cancer_type for i in np.flatnonzero(at == j)] for j in range(k) if (at == j).any()]
            best = (min(best[0], min(map(len, cells))), min(best[1], min(len(set(v)) for v in cells)))
        assert got[m] == best
    assert privacy.cluster_privacy(syn.limit(0), ["age"], "cancer_type").count() == 0


def test_replicates_of_whole_tables_equal_numpy(spark, tables):
    real, _, syn = tables
    got = {(r.method, r.metric): r.value for r in neighbours.replicates(real, syn, ["age", "time"], 1000, 1, matched=False).collect()}
    x = real.select("age", "time").toPandas().to_numpy()
    lo, hi = x.min(0), x.max(0)
    x = (x - lo) / (hi - lo)
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 0.5**2)).mean()
    for m in ("half", "other", "flat"):
        y = (syn.where(F.col("method") == m).select("age", "time").toPandas().to_numpy() - lo) / (hi - lo)
        assert got[m, "mmd_rbf"] == pytest.approx(kernel(x, x) + kernel(y, y) - 2 * kernel(x, y), abs=1e-9)
    runs = neighbours.replicates(real, syn, ["age", "time"], 30, 3, seed=1)
    assert runs.select("method", "b").distinct().count() == 9
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, neighbours.replicates(real.repartition(7), syn.repartition(2), ["age", "time"], 30, 3, seed=1).collect()))
