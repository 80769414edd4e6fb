"""Hand-checked golden values (FIXTURES.md) and edge tables."""

import math

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.windows import prefix_sum, window_prefix_sum
from cohortflow.operators import fidelity, repair, sample, survival
from cohortflow.schema import DEFAULT


def _df(spark, rows, schema="time double, status int"):
    return spark.createDataFrame(rows, schema)


def test_km_golden(spark):
    df = _df(spark, [(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1)])
    km = {r.time: r.s for r in survival.kaplan_meier(df).collect()}
    assert km[1.0] == pytest.approx(0.75)
    assert km[2.0] == pytest.approx(0.75)
    assert km[3.0] == pytest.approx(0.375)
    assert km[4.0] == 0.0


def test_km_edges(spark):
    all_cens = _df(spark, [(1.0, 0), (2.0, 0), (2.0, 0)])
    assert {r.s for r in survival.kaplan_meier(all_cens).collect()} == {1.0}
    all_ev = _df(spark, [(1.0, 1), (2.0, 1)])
    s = sorted((r.time, r.s) for r in survival.kaplan_meier(all_ev).collect())
    assert s[0][1] == pytest.approx(0.5) and s[1][1] == 0.0
    one = _df(spark, [(5.0, 1)])
    assert survival.kaplan_meier(one).first().s == 0.0
    # tied event and censoring at the same time: censored still at risk
    tie = _df(spark, [(1.0, 1), (1.0, 0), (2.0, 1)])
    s = dict((r.time, r.s) for r in survival.kaplan_meier(tie).collect())
    assert s[1.0] == pytest.approx(2 / 3)
    assert s[2.0] == 0.0


def test_km_monotone_in_unit_interval(spark):
    from tests.conftest import SF_SMALL
    from cohortflow.plans import cohort

    tr, _ = cohort.train_test(spark, SF_SMALL)
    km = survival.kaplan_meier(tr, DEFAULT, ["subgroup"]).collect()
    by = {}
    for r in km:
        by.setdefault(r.subgroup, []).append((r.time, r.s))
    for rows in by.values():
        rows.sort()
        ss = [s for _, s in rows]
        assert all(0.0 <= s <= 1.0 for s in ss)
        assert all(a >= b - 1e-12 for a, b in zip(ss, ss[1:]))


def test_concordance_golden(spark):
    rows = [(float(t), e, float(t)) for t, e in [(1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (6, 0)]]
    df = spark.createDataFrame(rows, "time double, status int, score double")
    assert survival.concordance(df, score="score").first().c_index == pytest.approx(1.0)
    rev = df.withColumn("score", -F.col("score"))
    assert survival.concordance(rev, score="score").first().c_index == pytest.approx(0.0)
    const = df.withColumn("score", F.lit(1.0))
    assert survival.concordance(const, score="score").first().c_index == pytest.approx(0.5)


def test_concordance_matches_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(float(rnd.randint(1, 30)), rnd.randint(0, 1), float(rnd.randint(0, 9))) for _ in range(300)]
    num = comp = 0.0
    for ti, ei, si in rows:
        if ei != 1:
            continue
        for tj, ej, sj in rows:
            if tj > ti or (tj == ti and ej == 0):
                comp += 1
                num += 1.0 if sj > si else (0.5 if sj == si else 0.0)
    df = spark.createDataFrame(rows, "time double, status int, score double")
    r = survival.concordance(df, score="score").first()
    assert r.n_comparable == comp
    assert r.c_index == pytest.approx(num / comp)


def test_w1_and_js_goldens(spark):
    real = spark.createDataFrame([(0.0,), (1.0,)], "value double").withColumn("g", F.lit("x"))
    syn = spark.createDataFrame([(1.0,), (2.0,)], "value double").withColumn("g", F.lit("x")) \
        .withColumn("method", F.lit("m"))
    w = fidelity.wasserstein_1d(real, syn, ["g"], "value", ["method"]).first().w1
    assert w == pytest.approx(1.0)
    same = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 4.0)], "a double, b double")
    js = fidelity.jensen_shannon(same, same.withColumn("method", F.lit("m")), ["a", "b"], ["method"]).collect()
    assert all(abs(r.js_distance) < 1e-12 for r in js)
    shifted = syn.withColumn("value", F.col("value") + 5.0)
    w2 = fidelity.wasserstein_1d(syn.drop("method"), shifted, ["g"], "value", ["method"]).first().w1
    assert w2 == pytest.approx(5.0)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    got = [r.y for r in df.select(F.bround("x", 0).alias("y")).collect()]
    assert got == [0.0, 2.0, 2.0]


def test_snap_ties_to_smaller(spark):
    real = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    syn = spark.createDataFrame([(1.5, 0), (3.0, 1), (None, 2), (9.0, 3), (-3.0, 4)], "v double, id int")
    params = repair.fit_precision(real, ["v"], 1000)
    out, _ = repair.match_precision(syn, params, 1000, skip=())
    got = {r.id: r.v for r in out.collect()}
    assert got == {0: 1.0, 1: 2.0, 2: None, 3: 4.0, 4: 1.0}
    single = spark.createDataFrame([(7.0,)], "v double")
    out, _ = repair.match_precision(syn, repair.fit_precision(single, ["v"]), 1000, skip=())
    assert {r.v for r in out.collect()} == {7.0, None}


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_prefix_sum_sliced_equals_window(spark, by, desc, inclusive):
    df = spark.range(0, 3000).select((F.col("id") % 4).cast("string").alias("g"),
                                     ((F.col("id") * 7) % 3000).cast("double").alias("t"),
                                     (F.col("id") % 5).alias("c"))
    a = prefix_sum(df, by, ["t"], ["c"], descending=desc, inclusive=inclusive, next_col="nx", slices=13)
    b = window_prefix_sum(df, by, ["t"], ["c"], descending=desc, inclusive=inclusive, next_col="nx2")
    j = a.join(b.withColumnRenamed("cum_c", "w"), ["g", "t", "c"])
    assert j.count() == 3000
    assert j.where("cum_c != w").count() == 0
    if not desc:
        assert j.where("NOT (nx <=> nx2)").count() == 0


def test_survival_gap_identical_is_zero(spark):
    df = _df(spark, [(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1), (6.0, 0)])
    syn = df.withColumn("method", F.lit("copy"))
    g = survival.survival_gap(df, syn, DEFAULT, syn_keys=["method"]).first()
    assert g.optimism == pytest.approx(0.0) and g.km_divergence == pytest.approx(0.0)
    assert g.short_sightedness == 0.0
    short = syn.withColumn("time", F.col("time") * 0.5)
    g = survival.survival_gap(df, short, DEFAULT, syn_keys=["method"]).first()
    assert g.short_sightedness == pytest.approx(0.5)
    assert g.optimism < 0
    assert not math.isnan(g.km_divergence)


@pytest.mark.parametrize("slices", [2, 4, 64])
def test_prefix_sum_keeps_null_groups(spark, slices):
    df = spark.createDataFrame([(g, float(t), 1) for g in (None, "a") for t in range(20)], "g string, t double, c int")
    got = prefix_sum(df, ["g"], ["t"], ["c"], slices=slices).collect()
    assert sorted((r.g or "", r.t, r.cum_c) for r in got) == sorted((g, float(t), t + 1) for g in ("", "a") for t in range(20))


def test_survival_gap_keeps_groups_without_a_real_side(spark):
    real = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), (None, 3.0, 1)], "grp string, time double, status int")
    syn = spark.createDataFrame([("m", "a", 1.5, 1), ("m", "b", 2.0, 1), ("m", None, 3.0, 1)], "method string, grp string, time double, status int")
    got = {r.grp: r for r in survival.survival_gap(real, syn, DEFAULT, by=["grp"], syn_keys=["method"]).collect()}
    assert set(got) == {"a", "b", None}
    assert got["b"].optimism is None and got["b"].short_sightedness is None
    assert got[None].optimism == pytest.approx(0.0) and got["a"].short_sightedness == pytest.approx(0.25)


def test_balanced_resample_gives_a_rare_class_its_share(spark):
    from cohortflow.operators import sample

    df = spark.createDataFrame([(k, None if k < 10 else k % 2) for k in range(2000)], "patient_id long, lab int")
    got = sample.balanced_resample(df, ["lab"], 3000, "patient_id").groupBy("lab").count().collect()
    assert sum(r["count"] for r in got) == 3000 and all(850 < r["count"] < 1150 for r in got) and len(got) == 3


def test_discrete_columns_take_text(spark):
    from cohortflow.operators import encode

    df = spark.createDataFrame([(f"t{k}", k % 2 == 0, float(k)) for k in range(50)], "a string, b boolean, x double")
    got = {r.column: (r.n_distinct, r.is_discrete) for r in encode.discrete_columns(df, ["a", "b", "x"]).collect()}
    assert got == {"a": (None, True), "b": (2, True), "x": (None, False)}


def test_integer_rule_per_method(spark):
    """A null in one synthetic table leaves the others whole numbers."""
    real = spark.createDataFrame([(i,) for i in range(5)], "v long")
    syn = spark.createDataFrame([("a", 1.4), ("a", 2.6), ("b", 3.3), ("b", None)], "method string, v double")
    out, report = repair.match_precision(syn, repair.fit_precision(real, ["v"], 2), 2, skip=(), by=["method"])
    assert sorted(r.v for r in out.where("method = 'a'").collect()) == [1.0, 3.0]
    assert {r.v for r in out.where("method = 'b'").collect()} == {3.3, None}
    assert {r.method: r.rule for r in report.collect()} == {"a": "round:0,int", "b": "round:0"}
    alone, _ = repair.match_precision(syn.where("method = 'a'"), repair.fit_precision(real, ["v"], 2), 2, skip=(), by=["method"])
    assert alone.schema["v"].dataType.simpleString() == "bigint"


def test_match_sizes_and_subsample_by_method(spark):
    real = spark.range(30).withColumnRenamed("id", "patient_id")
    syn = spark.createDataFrame([("big", i) for i in range(50)] + [("small", i) for i in range(10)], "method string, patient_id long")
    a, b = sample.match_sizes(real, syn, "patient_id", "patient_id")
    size = lambda d: {r.method: r["count"] for r in d.groupBy("method").count().collect()}
    assert size(a) == size(b) == {"big": 30, "small": 10}
    got = sample.subsample(syn, 20, "patient_id", by="method")
    assert size(got) == {"big": 20, "small": 20}
    assert got.where("method = 'big'").distinct().count() == 20
