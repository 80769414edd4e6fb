"""E10 and F10 fit on whole tables; Brier scores of trees without a row on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import cox, evaluate, models
from cohortflow.schema import DEFAULT


def test_downstream_fits_are_not_capped(spark, monkeypatch):
    n = F.col("id")
    real = spark.range(20_500).select(n.alias("patient_id"), (n % 50 + 1.0).alias("time"), (n % 2).cast("int").alias("status"), F.sin(n).alias("x"))

    class Asked(Exception):
        pass

    def asked(tables, *args, **kwargs):
        raise Asked({r["_fit"]: r["count"] for r in tables.groupBy("_fit").count().collect()})

    monkeypatch.setattr(cox, "fit_many", asked)
    with pytest.raises(Asked) as found:
        evaluate.downstream(real, real.limit(5), real.withColumn("method", F.lit("m")), DEFAULT, ["x"])
    assert found.value.args[0] == {"": 20_500, "m:m": 20_500}


def test_queries_ask_for_no_cap(spark, monkeypatch):
    from cohortflow.plans import catalog, q_models  # noqa: F401

    asked = []
    monkeypatch.setattr(q_models, "_tables", lambda *a: (None, None, None))
    monkeypatch.setattr(evaluate, "downstream", lambda *a, **k: asked.append(k) or spark.range(1))
    q_models.q_e10(None, ""), q_models.q_f10(None, "")
    assert len(asked) == 2 and all(k.get("max_n") is None for k in asked)


def test_brier_of_residual_curves_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 300) / 2
    t, e = np.round(np.exp(x + rng.normal(size=300)), 1) + 0.1, (rng.random(300) < 0.6).astype(int)
    df = spark.createDataFrame([("f", k, float(a), int(b), float(c)) for k, (a, b, c) in enumerate(zip(t, e, x))], "_fit string, patient_id long, time double, status int, x double")
    fitted = models.fit_log_time(df, DEFAULT, ["x"], trees=5, fit=F.col("_fit"))
    steps = evaluate.residual_steps(df, fitted, DEFAULT, ["x"])
    v, w, alive = np.round(rng.normal(size=200), 1), rng.random(200), rng.integers(0, 2, 200)
    asked = spark.createDataFrame([("f", float(a), float(b), float(c)) for a, b, c in zip(v, w, alive)], "_fit string, _v double, _w double, _alive double")
    residual = np.log(t) - fitted["f"].raw(x[:, None])
    s = np.array([np.prod([1 - e[residual == u].sum() / (residual >= u).sum() for u in np.unique(residual[residual <= q])]) for q in v])
    assert evaluate.residual_briers(asked, steps)["f"] == pytest.approx((w * (alive - s) ** 2).mean(), abs=1e-9)
