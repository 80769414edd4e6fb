"""F24 computes the metrics once, however its columns are found."""

from pyspark.sql import functions as F

from cohortflow.operators import compare


def test_comparison_computes_metrics_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    long = spark.createDataFrame([("a", "test", "m.x", 1.0), ("a", "train", "m.y", None), ("b", "test", "m.x", 2.5), (None, "test", "m.x", 3.0)],
                                 "method string, vs string, metric string, value double").mapInArrow(rows, "method string, vs string, metric string, value double")
    wide = compare.method_comparison(long, ["m.y"])
    assert wide.columns == ["method", "train__m.y", "test__m.x"]
    got = {r["method"]: (r["train__m.y"], r["test__m.x"]) for r in wide.orderBy(F.col("method")).collect()}
    assert got == {"a": (None, 1.0), "b": (None, 2.5), None: (None, 3.0)}
    assert seen.value == 4
