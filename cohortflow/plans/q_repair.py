"""Queries for output repair and synthetic-vs-real checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import clean, repair
from cohortflow.plans import cohort, pipeline
from cohortflow.plans.oracle import with_ctes
from cohortflow.plans.oracle_clean import CLEAN_SYN
from cohortflow.plans.registry import register
from cohortflow.schema import DEFAULT

FEATURES = ["age", "ancestry", "cancer_type", "subgroup", "sex", "msi_type", "mutation_count",
            "tmb", "fga", "purity", "ploidy"]
INT_FEATURES = ["age", "ancestry", "cancer_type", "subgroup", "sex", "msi_type", "mutation_count"]
SNAP = ["age", "ancestry", "cancer_type", "subgroup", "sex", "msi_type", "mutation_count", "fga",
        "purity", "ploidy"]


def clean_syn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(real clean train, five synthetic methods drawn from it)."""
    res = pipeline.clean_cohort(spark, sf_dir)
    tr = res.train
    return tr, cohort.synthetic_methods(tr)


NORM_SQL = """csyn_n AS (
  SELECT * REPLACE (
    CAST(least(greatest(round_even(CAST(status AS DOUBLE), 0), 0.0), 1.0) AS INTEGER) AS status,
    CASE WHEN time < 0.001 THEN 0.001::DOUBLE ELSE CAST(time AS DOUBLE) END AS time)
  FROM csyn
)"""


@register("B21_normalise_labels", with_ctes(*CLEAN_SYN, NORM_SQL, tail=f"""
SELECT method, patient_id, status, {sql_r6('time')} AS time FROM csyn_n"""))
def q_b21(spark, sf_dir):
    _, syn = clean_syn(spark, sf_dir)
    return round_floats(clean.normalise_labels(syn, DEFAULT).select("method", "patient_id", "status", "time"))


@register("B22_clip_time_to_real", with_ctes(*CLEAN_SYN, NORM_SQL, """
rng AS (SELECT greatest(min(time), 0.001::DOUBLE) AS tmin,
               greatest(max(time), greatest(min(time), 0.001::DOUBLE) * 1.01::DOUBLE) AS tmax FROM ctrain)""",
    tail=f"""
SELECT method, count(*)::BIGINT AS n, count_if(time < tmin)::BIGINT AS n_below,
       count_if(time > tmax)::BIGINT AS n_above,
       {sql_r6('quantile_cont(time, 0.01)')} AS q01, {sql_r6('quantile_cont(time, 0.5)')} AS q50,
       {sql_r6('quantile_cont(time, 0.99)')} AS q99,
       {sql_r6('avg(least(greatest(time, tmin), tmax))')} AS mean_clipped
FROM csyn_n, rng GROUP BY method"""))
def q_b22(spark, sf_dir):
    real, syn = clean_syn(spark, sf_dir)
    syn = clean.normalise_labels(syn, DEFAULT)
    clipped, report = clean.clip_time_to_real(syn, real, DEFAULT, by=["method"])
    m = clipped.groupBy("method").agg(F.avg("time").alias("mean_clipped"))
    return round_floats(report.join(m, "method"))


def _precision(spark, sf_dir):
    real, syn = clean_syn(spark, sf_dir)
    params = repair.fit_precision(real, FEATURES, 1000)
    return repair.match_precision(syn, params, 1000, skip=("time", "status"), by=["method"])


def _snap_sql(col: str) -> str:
    return f"(SELECT v FROM rv WHERE c = '{col}' ORDER BY abs(CAST(s.{col} AS DOUBLE) - v), v LIMIT 1)"


_RV = "rv AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM ctrain" for c in SNAP) + ")"


@register("B24_snap_to_real_values", with_ctes(*CLEAN_SYN, _RV, tail="SELECT s.method, s.patient_id, " + ", ".join(
    (f"CAST({_snap_sql(c)} AS BIGINT) AS {c}" if c in INT_FEATURES else f"{sql_r6(_snap_sql(c))} AS {c}")
    for c in SNAP) + " FROM csyn s"))
def q_b24(spark, sf_dir):
    out, _ = _precision(spark, sf_dir)
    return round_floats(out.select("method", "patient_id", *SNAP))


@register("B24_precision_report", with_ctes(*CLEAN_SYN, _RV, """
snapped AS (SELECT s.method, """ + ", ".join(f"{_snap_sql(c)} AS {c}" for c in SNAP) + """ FROM csyn s)""",
    tail=" UNION ALL ".join(f"""
SELECT b.method, '{c}' AS "column", b.nb AS syn_nuniq_before, a.na AS syn_nuniq_after,
       (SELECT count(DISTINCT {c}) FROM ctrain)::BIGINT AS real_nuniq
FROM (SELECT method, count(DISTINCT {c})::BIGINT AS nb FROM csyn GROUP BY method) b
JOIN (SELECT method, count(DISTINCT {c})::BIGINT AS na FROM snapped GROUP BY method) a USING (method)"""
                                 for c in SNAP)))
def q_b24_report(spark, sf_dir):
    _, rep = _precision(spark, sf_dir)
    return rep.select(
        "method", "column", F.col("syn_nuniq_before").cast("bigint"), F.col("syn_nuniq_after").cast("bigint"),
        "real_nuniq").where(F.col("column").isin(SNAP))


_DEC = "coalesce(" + ", ".join(f"CASE WHEN round_even(tmb, {d}) = tmb THEN {d} END" for d in range(19)) + ", 18)"


@register("B25_round_to_real_decimals", with_ctes(*CLEAN_SYN, f"""
dec AS (SELECT max({_DEC}) AS d FROM ctrain)""", tail=f"""
SELECT method, patient_id, {sql_r6('round_even(tmb, CAST(d AS INTEGER))')} AS tmb FROM csyn, dec"""))
def q_b25(spark, sf_dir):
    out, _ = _precision(spark, sf_dir)
    return round_floats(out.select("method", "patient_id", "tmb"))


# Default constraints (repair.DEFAULT_CONSTRAINTS) as SQL rows
_DEFAULTS_SQL = """defaults(c, d_dtype, d_lo, d_hi) AS (VALUES
  ('age', 'int', 0.0::DOUBLE, 120.0::DOUBLE), ('mutation_count', 'int', 0.0::DOUBLE, NULL::DOUBLE),
  ('fga', 'float', 0.0::DOUBLE, 1.0::DOUBLE), ('purity', 'float', 0.0::DOUBLE, 100.0::DOUBLE),
  ('ploidy', 'float', 0.0::DOUBLE, NULL::DOUBLE), ('tmb', 'float', 0.0::DOUBLE, NULL::DOUBLE),
  ('time', 'float', 0.001::DOUBLE, NULL::DOUBLE), ('status', 'int', 0.0::DOUBLE, 1.0::DOUBLE))"""
_NUMERIC_REAL = FEATURES + ["status", "time"]
_INFERRED_SQL = "inferred AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, CASE WHEN coalesce(bool_and(CAST({c} AS DOUBLE) = round_even(CAST({c} AS DOUBLE), 0)), false)
        THEN 'int' ELSE 'float' END AS i_dtype, min(CAST({c} AS DOUBLE)) AS i_lo, max(CAST({c} AS DOUBLE)) AS i_hi FROM ctrain"""
    for c in _NUMERIC_REAL) + ")"


@register("B26_resolve_constraints", with_ctes(*CLEAN_SYN, _DEFAULTS_SQL, _INFERRED_SQL, tail=f"""
SELECT i.c AS "column", coalesce(d_dtype, i_dtype) AS dtype,
       {sql_r6('CASE WHEN d_dtype IS NOT NULL THEN d_lo ELSE i_lo END')} AS lo,
       {sql_r6('CASE WHEN d_dtype IS NOT NULL THEN d_hi ELSE i_hi END')} AS hi,
       CASE WHEN d_dtype IS NOT NULL THEN 'default_map' ELSE 'inferred' END AS source
FROM inferred i LEFT JOIN defaults d ON d.c = i.c"""))
def q_b26(spark, sf_dir):
    real, _ = clean_syn(spark, sf_dir)
    return round_floats(repair.resolve_constraints(real.select(*_NUMERIC_REAL), None))


def _enforce(spark, sf_dir, with_meta=False):
    real, syn = clean_syn(spark, sf_dir)
    real = real.select(*_NUMERIC_REAL)
    cons = repair.resolve_constraints(real, None)
    return repair.enforce_constraints(syn.select("method", "patient_id", *_NUMERIC_REAL), cons, by=["method"])


_CONS = """cons AS (SELECT i.c, coalesce(d_dtype, i_dtype) AS dtype,
       CASE WHEN d_dtype IS NOT NULL THEN d_lo ELSE i_lo END AS lo,
       CASE WHEN d_dtype IS NOT NULL THEN d_hi ELSE i_hi END AS hi
  FROM inferred i LEFT JOIN defaults d ON d.c = i.c)"""


def _clip_sql(c):
    x = f"CAST(s.{c} AS DOUBLE)"
    lo = f"(SELECT lo FROM cons WHERE c = '{c}')"
    hi = f"(SELECT hi FROM cons WHERE c = '{c}')"
    dt = f"(SELECT dtype FROM cons WHERE c = '{c}')"
    y = f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"
    return y, dt


@register("B27_enforce_constraints", with_ctes(*CLEAN_SYN, _DEFAULTS_SQL, _INFERRED_SQL, _CONS, tail=
    "SELECT s.method, s.patient_id, " + ", ".join(
        (f"CAST(round_even({_clip_sql(c)[0]}, 0) AS BIGINT) AS {c}" if c in INT_FEATURES + ["status"]
         else f"{sql_r6(_clip_sql(c)[0])} AS {c}") for c in _NUMERIC_REAL) + " FROM csyn s"))
def q_b27(spark, sf_dir):
    out, _ = _enforce(spark, sf_dir)
    return round_floats(out)


@register("B27_constraint_report", with_ctes(*CLEAN_SYN, _DEFAULTS_SQL, _INFERRED_SQL, _CONS, tail=" UNION ALL ".join(
    f"""SELECT s.method, '{c}' AS "column",
      coalesce(count_if(CAST(s.{c} AS DOUBLE) < k.lo), 0)::BIGINT AS n_below,
      coalesce(count_if(CAST(s.{c} AS DOUBLE) > k.hi), 0)::BIGINT AS n_above,
      count_if(k.dtype = 'int' AND (CASE WHEN CAST(s.{c} AS DOUBLE) < k.lo THEN k.lo WHEN CAST(s.{c} AS DOUBLE) > k.hi THEN k.hi ELSE CAST(s.{c} AS DOUBLE) END)
               <> round_even(CASE WHEN CAST(s.{c} AS DOUBLE) < k.lo THEN k.lo WHEN CAST(s.{c} AS DOUBLE) > k.hi THEN k.hi ELSE CAST(s.{c} AS DOUBLE) END, 0))::BIGINT AS n_rounded,
      any_value(k.dtype) AS dtype
    FROM csyn s, (SELECT * FROM cons WHERE c = '{c}') k GROUP BY s.method""" for c in _NUMERIC_REAL)))
def q_b27_report(spark, sf_dir):
    _, rep = _enforce(spark, sf_dir)
    return rep.select("method", "column", "n_below", "n_above", "n_rounded", "dtype")


@register("D8_standard_scale", with_ctes(*CLEAN_SYN, "st AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in FEATURES + ["time"])
    + " FROM ctrain)", tail="SELECT patient_id, " + ", ".join(
        f"{sql_r6(f'(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}"
        for c in FEATURES + ["time"]) + " FROM ctest, st"))
def q_d8(spark, sf_dir):
    res = pipeline.clean_cohort(spark, sf_dir)
    params = repair.fit_scale(res.train, FEATURES + ["time"])
    return round_floats(repair.scale(res.test.select("patient_id", *FEATURES, "time"), params))


_DISCRETE = {c: None for c in INT_FEATURES}


def _discrete_bounds(res):
    b = res.train.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
                        for c in INT_FEATURES]).first()
    return {c: (b[c]["lo"], b[c]["hi"]) for c in INT_FEATURES}


@register("B28_decode_standardised", with_ctes(*CLEAN_SYN, "st AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}, "
    f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in FEATURES + ["time"])
    + " FROM ctrain)", """z AS (SELECT patient_id, """ + ", ".join(
        f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} * 1.1::DOUBLE AS {c}" for c in FEATURES + ["time"]) + " FROM ctest, st)",
    tail="SELECT patient_id, " + ", ".join(
        (f"least(greatest(round_even(z.{c} * s_{c} + m_{c}, 0), lo_{c}), hi_{c}) AS {c}" if c in INT_FEATURES else
         (f"{sql_r6(f'greatest(z.{c} * s_{c} + m_{c}, 0.0)')} AS {c}" if c == "time" else
          f"{sql_r6(f'z.{c} * s_{c} + m_{c}')} AS {c}")) for c in FEATURES + ["time"]) + " FROM z, st"))
def q_b28(spark, sf_dir):
    """Standardise the real test rows with train parameters, inflate by 1.1
    (a stand-in for a generator's z-space output), decode back."""
    res = pipeline.clean_cohort(spark, sf_dir)
    cols = FEATURES + ["time"]
    params = repair.fit_scale(res.train, cols)
    z = repair.scale(res.test.select("patient_id", *cols), params)
    z = z.select("patient_id", *[(F.col(c) * 1.1).alias(c) for c in cols])
    return round_floats(repair.decode_standardised(z, params, _discrete_bounds(res)))


@register("B29_reorder_columns", with_ctes(*CLEAN_SYN, tail=
    "SELECT " + ", ".join(["time", "status"] + [c for c in pipeline.CLEAN_ORDER if c not in ("time", "status")]).replace(
        "tmb", sql_r6("tmb") + " AS tmb").replace("fga", sql_r6("fga") + " AS fga").replace(
        "purity", sql_r6("purity") + " AS purity").replace("ploidy", sql_r6("ploidy") + " AS ploidy").replace(
        "time,", sql_r6("time") + " AS time,", 1) + " FROM ctest"))
def q_b29(spark, sf_dir):
    res = pipeline.clean_cohort(spark, sf_dir)
    return round_floats(repair.reorder(res.test, pipeline.CLEAN_ORDER, first=["time", "status"]))


@register("G2_postprocess_generated", with_ctes(*CLEAN_SYN, NORM_SQL, _DEFAULTS_SQL, _INFERRED_SQL, _CONS, _RV, f"""
rng AS (SELECT greatest(min(time), 0.001::DOUBLE) AS tmin,
               greatest(max(time), greatest(min(time), 0.001::DOUBLE) * 1.01::DOUBLE) AS tmax FROM ctrain)""",
    f"""dec AS (SELECT max({_DEC}) AS d FROM ctrain)""",
    """tclip AS (SELECT csyn_n.* REPLACE (least(greatest(time, tmin), tmax) AS time) FROM csyn_n, rng)""",
    "prec AS (SELECT s.method, s.patient_id, s.status, s.time, round_even(s.tmb, CAST(d AS INTEGER)) AS tmb, " + ", ".join(
        f"{_snap_sql(c)} AS {c}" for c in SNAP) + " FROM tclip s, dec)",
    tail="SELECT s.method, s.patient_id, " + ", ".join(
        (f"CAST(round_even({_clip_sql(c)[0]}, 0) AS BIGINT) AS {c}" if c in INT_FEATURES + ["status"]
         else f"{sql_r6(_clip_sql(c)[0])} AS {c}") for c in _NUMERIC_REAL) + " FROM prec s"))
def q_g2(spark, sf_dir):
    real, syn = clean_syn(spark, sf_dir)
    syn = clean.normalise_labels(syn.select("method", "patient_id", *_NUMERIC_REAL), DEFAULT)
    real = real.select(*_NUMERIC_REAL)
    out = postprocess(syn, real)
    return round_floats(out)


def postprocess(syn: DataFrame, real: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """B22 clip time -> B24/B25 precision -> B27 constraints, in that order."""
    syn = clean.clip_time(syn, real, DEFAULT)
    params = repair.fit_precision(real, [c for c in real.columns if c not in ("time", "status")], 1000)
    by = [c for c in ("method",) if c in syn.columns]
    syn, _ = repair.match_precision(syn, params, 1000, by=by)
    cons = repair.resolve_constraints(real, metadata)
    syn, _ = repair.enforce_constraints(syn, cons)
    return syn


@register("F25_mean_comparison", with_ctes(*CLEAN_SYN, tail=" UNION ALL ".join(
    f"""SELECT s.method, '{c}' AS "column", {sql_r6('r.m')} AS real_mean, {sql_r6('s.m')} AS syn_mean,
       {sql_r6('abs(r.m - s.m) / (abs(r.m) + 1e-8) * 100.0')} AS rel_diff_pct
    FROM (SELECT method, avg(CAST({c} AS DOUBLE)) AS m FROM csyn GROUP BY method) s,
         (SELECT avg(CAST({c} AS DOUBLE)) AS m FROM ctrain) r""" for c in _NUMERIC_REAL)))
def q_f25(spark, sf_dir):
    real, syn = clean_syn(spark, sf_dir)
    from cohortflow.operators import fidelity
    return round_floats(fidelity.mean_comparison(real.select(*_NUMERIC_REAL), syn, _NUMERIC_REAL, by=["method"]))
