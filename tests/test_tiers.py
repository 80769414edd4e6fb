from cohortflow.operators import evaluate
from cohortflow.schema import DEFAULT


def test_cheap_tier_has_every_metric_for_both_references(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i + 1), i % 2, float(i % 7)) for i in range(20)], "patient_id long, time double, status int, age double")
    syn = df.selectExpr("'a' as method", "*")
    one = lambda *_, metric="m", **__: spark.createDataFrame([("a", metric, 0.5)], "method string, metric string, value double")
    monkeypatch.setattr(evaluate, "detection_auc", lambda *a, model="gbt", **k: one(metric="mlp" if model == "mlp" else "gbt").selectExpr("*", "'x' as verdict"))
    monkeypatch.setattr(evaluate, "feature_rank_distance", lambda *a, **k: one(metric="rank"))
    asked = {}

    def downstream(*a, **k):
        asked.update(k)
        names = ["cox_trtr", "cox_tstr_id", "xgb_tstr", "xgb_tstr_id", "brier_tstr_aft", "brier_tstr_aft_id"]
        return spark.createDataFrame([("a", f"custom.{n}", 0.5) for n in names], "method string, metric string, value double")

    monkeypatch.setattr(evaluate, "downstream", downstream)
    got = {(r["vs"], r["metric"]) for r in evaluate.run_metrics(df, df, syn, DEFAULT, ["age"], heavy=False).collect()}
    for vs in ("train", "test"):
        assert {(vs, m) for m in ("gbt", "mlp", "rank", "performance.xgb.xgb_tstr", "performance.linear_model.brier_tstr_aft")} <= got
    assert asked["trees"] and asked["brier"] and asked["on_train"]


def test_tasks_started_by_tasks(spark):
    inner = lambda: evaluate.together([lambda: spark.range(3).count()])
    assert evaluate.together([inner, inner]) == [[3], [3]]
