"""Exact quantiles against numpy: nulls, NaN, ties, a hot group and slices."""

import numpy as np
import pytest

from cohortflow.functions.quantiles import grouped_quantiles, quantile_map

QS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("slices", ["1", "4", "64"])
def test_grouped_quantiles_match_numpy(spark, slices):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 300)] + [("a", float(v)) for v in rng.normal(size=7)]
    rows += [(None, 5.0), (None, 1.0), ("one", 2.5), ("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = {r.g: r.q for r in grouped_quantiles(df, ["g"], QS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {g: [v for k, v in rows if k == g and v is not None and v == v] for g in ("hot", "a", None, "one")}
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g] == pytest.approx(np.quantile(values, QS).tolist())


def test_columns_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "a int, b double")
    assert quantile_map(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    assert quantile_map(df.where("a > 9"), ["a"], [0.5, 0.9]) == {"a": [None, None]}


def test_whole_table_quantiles(spark):
    df = spark.range(11).selectExpr("cast(id as double) as value")
    assert grouped_quantiles(df, [], [0.25, 0.5]).first().q == [2.5, 5.0]
