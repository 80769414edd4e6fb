"""Query registry: one Spark plan per operator, each with a DuckDB oracle.

Every query reads the given parquet tables (through the derived cohort) and
runs over all of their rows. Float outputs are rounded to 6 places in both
engines so the driver's value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import compare
from cohortflow.plans import cohort
from cohortflow.plans.oracle import BASE_SYN, gap_sql, with_ctes
from cohortflow.schema import DEFAULT

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _syn_norm_sql() -> str:
    return """syn_n AS (
  SELECT * REPLACE (
    CAST(least(greatest(round_even(CAST(status AS DOUBLE), 0), 0.0), 1.0) AS INTEGER) AS status,
    CASE WHEN time < 0.001 THEN 0.001::DOUBLE ELSE CAST(time AS DOUBLE) END AS time)
  FROM syn
)"""


# ------------------------------------------------------------------ F22 -----

def subgroup_report_query(spark: SparkSession, sf_dir: str, min_n: int = 50) -> DataFrame:
    train, test = cohort.train_test(spark, sf_dir)
    syn = cohort.synthetic_methods(train)
    rep = compare.subgroup_report(test, syn, DEFAULT, group="cancer_type", top_k=12, min_n=min_n)
    return round_floats(rep)


def _subgroup_sql(min_n: int = 50) -> str:
    tail = f"""
SELECT b.method, CAST(b.g AS VARCHAR) AS cancer_type, b.n_real, b.n_syn,
  {sql_r6('CASE WHEN ok THEN optimism END')} AS optimism,
  {sql_r6('CASE WHEN ok THEN km_divergence END')} AS km_divergence,
  {sql_r6('CASE WHEN ok THEN short_sightedness END')} AS short_sightedness,
  {sql_r6('CASE WHEN ok THEN abs(real_event_rate - syn_event_rate) END')} AS censoring_rate_diff,
  {sql_r6('real_event_rate')} AS real_event_rate,
  {sql_r6('syn_event_rate')} AS syn_event_rate
FROM (SELECT *, n_real >= {min_n} AND n_syn >= {min_n} AS ok FROM base) b
LEFT JOIN gap ON gap.method = b.method AND gap.g = b.g"""
    return with_ctes(*BASE_SYN, _syn_norm_sql(), f"""
top AS (SELECT cancer_type AS g FROM test WHERE cancer_type IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 12),
methods AS (SELECT DISTINCT method FROM syn_n),
r_stats AS (SELECT cancer_type AS g, CAST(count(*) AS BIGINT) AS n_real,
                   avg(CAST(status AS DOUBLE)) AS real_event_rate
            FROM test WHERE cancer_type IN (SELECT g FROM top) GROUP BY 1),
s_stats AS (SELECT method, cancer_type AS g, CAST(count(*) AS BIGINT) AS n_syn,
                   avg(CAST(status AS DOUBLE)) AS syn_event_rate
            FROM syn_n WHERE cancer_type IN (SELECT g FROM top) GROUP BY 1, 2),
base AS (
  SELECT m.method, top.g, coalesce(n_real, 0)::BIGINT AS n_real, coalesce(n_syn, 0)::BIGINT AS n_syn,
         real_event_rate, syn_event_rate
  FROM methods m CROSS JOIN top
  LEFT JOIN s_stats s ON s.method = m.method AND s.g = top.g
  LEFT JOIN r_stats r ON r.g = top.g
),
ok_pairs AS (SELECT method, g FROM base WHERE n_real >= {min_n} AND n_syn >= {min_n}),
real_g AS (SELECT cancer_type AS g, time, status FROM test WHERE cancer_type IN (SELECT g FROM top)),
syn_g AS (SELECT s.method, s.cancer_type AS g, s.time, s.status FROM syn_n s
          JOIN ok_pairs p ON p.method = s.method AND p.g = s.cancer_type),
""" + gap_sql("real_g", "syn_g", ["g"], ["method"]).strip(), tail=tail)


register("F22_subgroup_report", _subgroup_sql())(subgroup_report_query)

