"""B23 fill semantics and plan shape checks (no nested-loop joins)."""

from pyspark.sql import functions as F

from cohortflow.operators import repair, survival
from cohortflow.schema import DEFAULT


def test_median_then_zero_fill(spark):
    codes = spark.createDataFrame([("c", "a", 0), ("c", "b", 1)], "column string, value string, code int")
    df = spark.createDataFrame([(1, "a", 1.0, None), (2, None, None, None), (3, "zzz", 3.0, None),
                                (4, "b", 5.0, None)], "id int, c string, x double, allnull double")
    out = {r.id: r for r in repair.median_then_zero_fill(df, codes, ["c", "x", "allnull"]).collect()}
    assert out[1].c == 0.0 and out[4].c == 1.0
    assert out[2].c == -1.0                  # null text -> -1, like a pandas category code
    # unseen text is missing -> median of the codes present (0, -1, 1) = 0
    assert out[3].c == 0.0
    assert out[2].x == 3.0                   # numeric null -> median of 1, 3, 5
    assert all(r.allnull == 0.0 for r in out.values())


def test_whole_table_gap_has_no_nested_loop_join(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "time double, status int")
    syn = df.withColumn("method", F.lit("m"))
    plan = survival.survival_gap(df, syn, DEFAULT, syn_keys=["method"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
