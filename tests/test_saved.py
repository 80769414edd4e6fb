"""Saved models score and generate as before; the conditional chain calls its models."""

from pyspark.sql import functions as F
from test_boosting import SCHEMA, cohort

from cohortflow.operators import models, saved, synth
from cohortflow.operators.cox import fit_many
from cohortflow.schema import DEFAULT


def test_models_come_back_equal(spark, tmp_path):
    df = spark.createDataFrame([r for r in cohort(200, 3) if r[4] is not None], SCHEMA)
    tte = models.TimeToEvent(points=8, trees=10, depth=3).fit(df, DEFAULT, ["x1", "x2"])
    cox = fit_many(df, DEFAULT, ["x1", "x2"], F.lit("a"))["a"]
    status = models.fit_censoring(df, DEFAULT, ["x1"], trees=5)
    path = saved.save_models(spark, {"tte": tte, "cox": cox, "status": status}, f"file://{tmp_path}/models")
    assert sorted(map(tuple, saved.manifest(spark, path).collect())) == [("cox", "CoxPH"), ("status", "dict"), ("tte", "TimeToEvent")]
    back = saved.load_models(spark, path)

    def rows(t, c, s):
        p = t.predict(c.score(df), F.lit(1), F.col("patient_id"), seed=3)
        return sorted(map(tuple, models.predict_status(s, p, ["x1"]).collect()))

    assert rows(tte, cox, status) == rows(back["tte"], back["cox"], back["status"])


def test_conditional_chain(spark):
    df = spark.createDataFrame([r for r in cohort(300, 3) if r[4] is not None], SCHEMA).select("patient_id", "x1", "x2", "status", "time")
    g = synth.ConditionalSynthesizer(DEFAULT, seed=1, trees=10, depth=3, q_points=32).fit(df, ["x1", "x2"])
    one, two = g.generate(spark, 80, seed=5), g.generate(spark, 80, seed=5).repartition(3)
    assert one.columns == ["row_idx", "x1", "x2", "status", "time"]
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect())) and rows != sorted(map(tuple, g.generate(spark, 80, seed=6).collect()))
    again = models.predict_status(g.censoring, one, ["x1", "x2"])
    assert again.exceptAll(one.select(again.columns)).count() == 0  # the status is the model's
    timed = g.tte.predict(one.drop("time"), F.col("status"), F.col("row_idx"), 5, "time").select(one.columns)
    assert timed.exceptAll(one).count() == 0  # and so is the time
