from pyspark.sql import functions as F

from cohortflow.operators import repair


def test_precision_counts_every_distinct_value(spark):
    n = F.col("id")
    df = spark.range(4000).select((n % 3000).alias("many"), (n % 1000 * 0.5).alias("few"), F.when(n % 2 > 0, n * 0.25).alias("half"))
    got = {r["column"]: r for r in repair.fit_precision(df, ["many", "few", "half"]).collect()}
    assert {c: r["real_nuniq"] for c, r in got.items()} == {"many": 3000, "few": 1000, "half": 2000}
    assert got["many"]["values"] is None and got["half"]["values"] is None and len(got["few"]["values"]) == 1000
    assert [r["real_is_int"] for r in map(got.get, ("many", "few"))] == [True, False]
