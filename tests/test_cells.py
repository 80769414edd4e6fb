"""Ranks by cells of the hash against ranks of all rows; stacked ranks, counts and marginals against plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortflow.functions.exprs import whole
from cohortflow.functions.quantiles import grouped_quantiles
from cohortflow.operators import fidelity, mixture, repair, sample


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_least_hashed_equals_ranks_of_all_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(sample, "CELL_BITS", bits)
    rows = [(f"p{i % 190}", m) for m, k in (("a", 300), ("b", 40), ("c", 7)) for i in range(k)] + [(None, "a"), (None, "c"), ("x", None)]
    df = spark.createDataFrame(rows, "id string, method string")
    sizes = [("a", 111), ("b", 40), ("c", 0), (None, 5)]
    got = sample.least_hashed(df, sizes, "id", 42, "method")
    ranked = sample.hash_ranked(df, "id", 42, ["method"])
    want = [tuple(r) for g, n in sizes for r in ranked.where(F.col("method").eqNullSafe(F.lit(g)) & (F.col("_rank") <= n)).select("id", "method").collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("bits", [1, 16])
def test_resample_draws_the_numbered_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(sample, "CELL_BITS", bits)
    monkeypatch.setattr(sample, "CELL_BLOCK", 4)
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(200)], "id long, lab int")
    got = {r.slot: (r.id, r.lab) for r in sample.balanced_resample(df, ["lab"], 400, "id").collect()}
    w = Window.partitionBy("lab").orderBy(sample.split_key("id", 42), "id")
    number = {(r.lab, r.n - 1): r.id for r in df.withColumn("n", F.row_number().over(w)).collect()}
    labels = sorted({k for k, _ in number}, key=lambda v: (v is not None, v or 0))
    u = sample.uniform
    slots = spark.range(400).select("id", F.floor(u(F.col("id"), "balanced:class", 42) * 4).alias("c"), u(F.col("id"), "balanced:row", 42).alias("at")).collect()
    sizes = {k: sum(1 for q, _ in number if q == k) for k in labels}
    assert got == {s.id: (number[labels[s.c], int(s.at * sizes[labels[s.c]])], labels[s.c]) for s in slots}


def test_sampling_and_quantiles_do_not_write_their_rows(spark, monkeypatch):
    from cohortflow.functions import windows

    written = []
    old = windows.materialize
    monkeypatch.setattr(windows, "materialize", lambda df, name="t": written.append(df.columns) or old(df, name))
    df = spark.range(500).selectExpr("id", "cast(id % 5 as int) as lab", "'wide' as payload")
    sample.balanced_resample(df, ["lab"], 20, "id").collect()
    sample.match_sizes(df.where("id < 90"), df.withColumn("method", F.lit("m")), "id", "id")
    assert written and not any("payload" in c for c in written)


def test_weighted_quantiles_and_modes(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", 5.0, 2)], "g string, value double, n long")
    long = df.select("g", "value", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    key = lambda r: r.g
    qs = [0.1, 0.7, 0.9]
    assert sorted(grouped_quantiles(df, ["g"], qs, weight="n").collect(), key=key) == sorted(grouped_quantiles(long, ["g"], qs).collect(), key=key)
    assert mixture.fit(long, ["value"], k=2, max_iter=3)["value"].m


def test_spearman_keeps_rows_whole(spark, monkeypatch):
    import pandas as pd

    rows = [("m" if i % 4 else "k", i, float(i * 7 % 11) if i % 9 else None, float(i * i % 23), None if i % 5 else float("nan"), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "method string, id long, a double, b double, c double, d int")
    frame = pd.DataFrame(rows, columns=["method", "id", "a", "b", "c", "d"])
    for sent in (0, 100_000):
        monkeypatch.setattr(fidelity, "RANKS_SENT", sent)
        got = {(r.method, r.c1, r.c2): r.rho for r in fidelity.spearman_panel(df, ["a", "b", "c", "d"], "id", ["method"]).collect()}
        plan = fidelity.average_ranks(df, ["a", "b", "c", "d"], "id", ["method"])
        assert plan.count() == 120
        for m, part in frame.groupby("method"):
            ranks = part[["b", "d"]].rank()
            assert got[m, "b", "d"] == pytest.approx(ranks.corr().loc["b", "d"])
            assert got[m, "a", "c"] is None


def test_distinct_counts_and_whole(spark):
    rows = [("x", 1.0, 5, None), ("x", 1.0, 6, None), ("x", float("nan"), 6, None), (None, None, 7, None)]
    df = spark.createDataFrame(rows, "method string, a double, b long, c double")
    got = {(r.method, r.column): r.k for r in repair._distinct_counts(df, ["a", "b", "c"], ["method"], "k").collect()}
    want = df.groupBy("method").agg(*[F.count_distinct(c).alias(c) for c in "abc"]).collect()
    assert got == {(r.method, c): r[c] for r in want for c in "abc"}
    values = [0.5, 1.5, 2.5, -0.5, -0.2, 0.0, 1e300, None, 4503599627370497.5, 2.4999999999999996]
    x = spark.createDataFrame([(v,) for v in values], "v double").select(whole(F.col("v")).alias("w"), F.bround("v", 0).alias("b")).collect()
    assert [str(r.w) for r in x] == [str(r.b) for r in x]


def test_marginals_stack_each_side_once(spark, monkeypatch):
    calls = []
    old = fidelity.stack
    monkeypatch.setattr(fidelity, "stack", lambda *a, **k: calls.append(1) or old(*a, **k))
    real = spark.createDataFrame([(float(i), i % 2) for i in range(100)], "t double, s int")
    syn = real.withColumn("method", F.lit("m")).unionByName(real.where("t < 50").withColumn("method", F.lit("n")))
    got = fidelity.marginal_table(real, syn, ["t", "s"], ["method"]).collect()
    assert len(calls) == 2
    share = {(r.method, r.x): (r.real, r.syn) for r in got if r.column == "s"}
    assert share["n", 1.0] == (0.5, 0.5)
    assert sum(r.real for r in got if r.column == "t" and r.method == "m") * (99 * 0.98) / 29 == pytest.approx(1.0)
