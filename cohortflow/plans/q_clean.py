"""Queries for sources, cleaning, de-dup and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import clean, sample
from cohortflow.plans import cohort, pipeline
from cohortflow.plans.oracle import BASE, LABELLED, PATIENTS, with_ctes
from cohortflow.plans.oracle_clean import CLEAN_BASE
from cohortflow.plans.registry import register
from cohortflow.sources import io
from cohortflow.sources.fixture import RAW_SQL, raw_samples

RAW_COLS = ["sample_id", "patient_id", "sample_type", "os_months", "os_status", "cancer_type",
            "subgroup", "age", "sex", "ancestry", "msi_type", "mutation_count", "tmb", "fga",
            "purity", "ploidy", "sparse_note", "h"]


def _raw_sql_cols(cols):
    out = []
    for c in cols:
        out.append(sql_r6(c) + f" AS {c}" if c in ("os_months", "tmb", "fga", "ploidy", "mutation_count") else c)
    return ", ".join(out)


def _stage(spark, sf_dir, name):
    return pipeline.clean_cohort(spark, sf_dir).stages[name]


# A1 ------------------------------------------------------------------------
@register("A1_read_cohort", with_ctes(RAW_SQL, tail=f"SELECT {_raw_sql_cols(RAW_COLS)} FROM raw"))
def q_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw samples as a CSV file with blanks around its header names, read with a schema."""
    from pyspark.sql import types as T

    raw = raw_samples(spark, sf_dir)
    padded = raw.toDF(*[f" {c} " for c in raw.columns])
    path = io.write_cohort(padded, io.scratch_dir(spark, "raw"), "csv")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in padded.schema.fields])
    return round_floats(io.read_cohort(spark, path, schema).select(*RAW_COLS))


# B1-B4 ---------------------------------------------------------------------
@register("B1_require_labels", with_ctes(RAW_SQL, tail=f"""
SELECT sample_id, {sql_r6('os_months')} AS os_months, os_status FROM raw
WHERE os_months IS NOT NULL AND os_status IS NOT NULL"""))
def q_b1(spark, sf_dir):
    df = clean.require_labels(raw_samples(spark, sf_dir), ["os_months", "os_status"])
    return round_floats(df.select("sample_id", "os_months", "os_status"))


@register("B2_parse_event", with_ctes(RAW_SQL, tail="""
SELECT sample_id, CAST(starts_with(os_status, '1') AS INTEGER) AS status FROM raw
WHERE os_months IS NOT NULL AND os_status IS NOT NULL"""))
def q_b2(spark, sf_dir):
    df = clean.require_labels(raw_samples(spark, sf_dir), ["os_months", "os_status"])
    return clean.parse_event(df, "os_status").select("sample_id", "status")


@register("B3_parse_time", with_ctes(RAW_SQL, tail=f"""
SELECT sample_id, {sql_r6('CAST(os_months AS DOUBLE)')} AS time FROM raw
WHERE os_months IS NOT NULL AND os_status IS NOT NULL"""))
def q_b3(spark, sf_dir):
    df = clean.require_labels(raw_samples(spark, sf_dir), ["os_months", "os_status"])
    df = clean.parse_time(df, "os_months", drop=["os_months", "os_status"])
    return round_floats(df.select("sample_id", "time"))


@register("B4_valid_time", with_ctes(RAW_SQL, LABELLED, tail=f"""
SELECT sample_id, {sql_r6('time')} AS time, status FROM labelled"""))
def q_b4(spark, sf_dir):
    return round_floats(cohort.labelled_samples(spark, sf_dir).select("sample_id", "time", "status"))


# C1-C2 ---------------------------------------------------------------------
@register("C1_dedupe_patient", with_ctes(RAW_SQL, LABELLED, PATIENTS, tail="""
SELECT patient_id, sample_id, sample_type FROM patients"""))
def q_c1(spark, sf_dir):
    return cohort.patient_cohort(spark, sf_dir).select("patient_id", "sample_id", "sample_type")


@register("C2_hash_split", with_ctes(*BASE, tail="""
SELECT patient_id, status, is_train FROM split"""))
def q_c2(spark, sf_dir):
    return cohort.split_cohort(spark, sf_dir).select("patient_id", "status", "is_train")


@register("C2_stratified_split_exact", with_ctes(RAW_SQL, LABELLED, PATIENTS, tail="""
SELECT patient_id, status,
       row_number() OVER (PARTITION BY status ORDER BY
         (('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|42'), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE, patient_id)
       <= floor(count(*) OVER (PARTITION BY status) * 0.8::DOUBLE) AS is_train
FROM patients"""))
def q_c2_exact(spark, sf_dir):
    p = cohort.patient_cohort(spark, sf_dir).select("patient_id", "status")
    return sample.stratified_split(p, ["status"], "patient_id", 0.8, 42)


# B5-B20 on the cleaning chain ------------------------------------------------
_DROPPED_COLS = ["patient_id", "cancer_type", "subgroup", "age", "sex", "ancestry", "msi_type",
                 "mutation_count", "tmb", "fga", "purity", "ploidy", "sparse_note", "h", "status",
                 "time", "is_train"]


@register("B5_drop_columns", with_ctes(*CLEAN_BASE, tail=f"""
SELECT {_raw_sql_cols(_DROPPED_COLS).replace(sql_r6('mutation_count') + ' AS mutation_count', sql_r6('mutation_count') + ' AS mutation_count')}, {sql_r6('time')} AS time_r
FROM dropped""".replace(", time, is_train", ", is_train")))
def q_b5(spark, sf_dir):
    df = _stage(spark, sf_dir, "dropped")
    df = df.withColumn("time_r", F.col("time")).drop("time")
    return round_floats(df)


@register("B8_fit_top_n", with_ctes(*CLEAN_BASE, tail="SELECT value, train_count FROM top"))
def q_b8_fit(spark, sf_dir):
    return pipeline.clean_cohort(spark, sf_dir).params["top"].withColumn(
        "train_count", F.col("train_count").cast("bigint"))


@register("B8_bucket_top_n", with_ctes(*CLEAN_BASE, tail="SELECT patient_id, cancer_type FROM bucketed"))
def q_b8(spark, sf_dir):
    return _stage(spark, sf_dir, "bucketed").select("patient_id", "cancer_type")


@register("B6_to_numeric", with_ctes(*BASE, tail="""
SELECT patient_id, TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(purity AS DOUBLE) AS purity FROM split"""))
def q_b6(spark, sf_dir):
    df = cohort.split_cohort(spark, sf_dir)
    return clean.to_numeric(df, ["age", "purity"]).select("patient_id", "age", "purity")


@register("B7_null_token", with_ctes(*BASE, tail="SELECT patient_id, NULLIF(msi_type, 'nan') AS msi_type FROM split"))
def q_b7(spark, sf_dir):
    return clean.null_token(cohort.split_cohort(spark, sf_dir), ["msi_type"]).select("patient_id", "msi_type")


@register("B9_clip_semantic", with_ctes(*CLEAN_BASE, tail="SELECT patient_id, purity FROM semantic_clipped"))
def q_b9(spark, sf_dir):
    return _stage(spark, sf_dir, "semantic_clipped").select("patient_id", "purity")


@register("B9_clip_report", with_ctes(*BASE, tail="""
SELECT is_train, 'purity' AS "column", count_if(p < 0)::BIGINT AS n_below, count_if(p > 100)::BIGINT AS n_above
FROM (SELECT is_train, TRY_CAST(purity AS DOUBLE) AS p FROM split) GROUP BY is_train"""))
def q_b9_report(spark, sf_dir):
    df = clean.to_numeric(cohort.split_cohort(spark, sf_dir), ["purity"])
    c = F.col("purity")
    return df.groupBy("is_train").agg(F.lit("purity").alias("column"),
                                      F.count_if(c < 0).cast("bigint").alias("n_below"),
                                      F.count_if(c > 100).cast("bigint").alias("n_above"))


_PROFILE_COLS = [("cancer_type", "string"), ("subgroup", "string"), ("age", "string"), ("sex", "string"),
                 ("ancestry", "string"), ("msi_type", "string"), ("mutation_count", "numeric"),
                 ("tmb", "numeric"), ("fga", "numeric"), ("purity", "numeric"), ("ploidy", "numeric"),
                 ("sparse_note", "string"), ("status", "numeric"), ("time", "numeric")]


def _profile_sql(src: str, cols) -> str:
    parts = [f"SELECT '{c}' AS var, avg(CAST({c} IS NULL OR (TRY_CAST({c} AS DOUBLE) = 'NaN'::DOUBLE AND '{k}' = 'numeric') AS DOUBLE)) AS proportion, '{k}' AS dtype FROM {src} WHERE is_train"
             for c, k in cols]
    return " UNION ALL ".join(parts)


def _kind(col):
    return F.when(F.col(col).isin("string", "boolean"), F.lit("string")).otherwise(F.lit("numeric"))


@register("B11_missing_profile", with_ctes(*CLEAN_BASE, tail=f"""
SELECT var, {sql_r6('proportion')} AS proportion, dtype FROM ({_profile_sql('semantic_clipped', _PROFILE_COLS)})
WHERE proportion > 0"""))
def q_b11(spark, sf_dir):
    prof = pipeline.clean_cohort(spark, sf_dir).params["missing_profile"]
    return round_floats(prof.select("var", "proportion", _kind("dtype").alias("dtype")))


@register("B12_drop_sparse", with_ctes(*CLEAN_BASE, tail=f"""
SELECT var, proportion > 0.40 AS dropped FROM ({_profile_sql('semantic_clipped', _PROFILE_COLS)})
WHERE proportion > 0"""))
def q_b12(spark, sf_dir):
    prof = pipeline.clean_cohort(spark, sf_dir).params["missing_profile"]
    return prof.select("var", (F.col("proportion") > 0.40).alias("dropped"))


_INT_CANDS = ["age", "mutation_count", "tmb", "fga", "ploidy"]


@register("B13_detect_integer_columns", with_ctes(*CLEAN_BASE, tail=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n_non_null,
       count({c}) > 0 AND coalesce(bool_and({c} = round_even({c}, 0)), true) AS is_integer
    FROM coerced WHERE is_train""" for c in _INT_CANDS)))
def q_b13(spark, sf_dir):
    df = _stage(spark, sf_dir, "coerced").where("is_train")
    return clean.integer_columns_check(df, _INT_CANDS)


@register("B14_impute_median", with_ctes(*CLEAN_BASE, tail=f"""
SELECT patient_id, {sql_r6('age')} AS age, {sql_r6('mutation_count')} AS mutation_count,
       {sql_r6('purity')} AS purity FROM imputed"""))
def q_b14(spark, sf_dir):
    return round_floats(_stage(spark, sf_dir, "imputed").select("patient_id", "age", "mutation_count", "purity"))


@register("B15_impute_constant", with_ctes(*CLEAN_BASE, tail="SELECT patient_id, ancestry, msi_type FROM imputed"))
def q_b15(spark, sf_dir):
    return _stage(spark, sf_dir, "imputed").select("patient_id", "ancestry", "msi_type")


@register("B10_fit_quantile_bounds", with_ctes(*CLEAN_BASE, tail=f"""
SELECT 'tmb' AS "column", 0.0::DOUBLE AS lo, {sql_r6('hi_tmb')} AS hi FROM p99
UNION ALL SELECT 'mutation_count', 0.0::DOUBLE, {sql_r6('hi_mut')} FROM p99"""))
def q_b10_fit(spark, sf_dir):
    df = _stage(spark, sf_dir, "imputed").where("is_train")
    return round_floats(clean.fit_quantile_bounds(df, pipeline.P99_COLUMNS, 0.99))


@register("B10_clip_quantile", with_ctes(*CLEAN_BASE, tail=f"""
SELECT patient_id, {sql_r6('tmb')} AS tmb, {sql_r6('mutation_count')} AS mutation_count FROM quantile_clipped"""))
def q_b10(spark, sf_dir):
    return round_floats(_stage(spark, sf_dir, "quantile_clipped").select("patient_id", "tmb", "mutation_count"))


@register("B16_restore_int", with_ctes(*CLEAN_BASE, tail="SELECT patient_id, age, mutation_count FROM restored"))
def q_b16(spark, sf_dir):
    return _stage(spark, sf_dir, "restored").select("patient_id", "age", "mutation_count")


@register("B17_categorical_profile", with_ctes(*CLEAN_BASE, tail=" UNION ALL ".join(
    f"""SELECT '{c}' AS var, CAST(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS nunique
    FROM restored WHERE is_train""" for c in ["cancer_type", "subgroup", "sex", "ancestry", "msi_type"])))
def q_b17(spark, sf_dir):
    df = _stage(spark, sf_dir, "restored").where("is_train")
    return clean.categorical_profile(df, exclude=pipeline.LABELS + ["is_train"] + pipeline.HIDDEN)


@register("B18_fit_label_codes", with_ctes(*CLEAN_BASE, tail='SELECT col AS "column", value, code FROM codes'))
def q_b18_fit(spark, sf_dir):
    return pipeline.clean_cohort(spark, sf_dir).params["codes"]


_ENC_COLS = ["patient_id", "cancer_type", "subgroup", "age", "sex", "ancestry", "msi_type", "mutation_count",
             "tmb", "fga", "purity", "ploidy", "h", "status", "time", "is_train"]


def _enc_sql_cols():
    fl = ("tmb", "fga", "purity", "ploidy", "time")
    return ", ".join(f"{sql_r6(c)} AS {c}" if c in fl else c for c in _ENC_COLS)


@register("B18_label_encode", with_ctes(*CLEAN_BASE, tail=f"SELECT {_enc_sql_cols()} FROM encoded"))
def q_b18(spark, sf_dir):
    return round_floats(_stage(spark, sf_dir, "encoded").select(*_ENC_COLS))


def _qc_sql(src, flag):
    cols = [c for c in _ENC_COLS if c not in ("is_train",)]
    nulls = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"""SELECT {flag} AS is_train, count(*)::BIGINT AS n_rows, {len(cols)} AS n_cols,
      count_if({nulls})::BIGINT AS n_rows_with_null, count_if(NOT (time > 0))::BIGINT AS n_bad_time,
      count_if(status NOT IN (0, 1))::BIGINT AS n_bad_status, {sql_r6('avg(CAST(status AS DOUBLE))')} AS event_rate
    FROM {src}"""


@register("B19_qc_check", with_ctes(*CLEAN_BASE, tail=_qc_sql("ctrain", "true") + " UNION ALL " + _qc_sql("ctest", "false")))
def q_b19(spark, sf_dir):
    res = pipeline.clean_cohort(spark, sf_dir)
    cols = [c for c in _ENC_COLS if c != "is_train"]
    a = clean.qc_check(res.train.select(*cols)).withColumn("is_train", F.lit(True))
    b = clean.qc_check(res.test.select(*cols)).withColumn("is_train", F.lit(False))
    return round_floats(a.unionByName(b))


_BOUND_COLS = [("cancer_type", "int"), ("subgroup", "int"), ("age", "int"), ("sex", "int"), ("ancestry", "int"),
               ("msi_type", "int"), ("mutation_count", "int"), ("tmb", "float"), ("fga", "float"),
               ("purity", "float"), ("ploidy", "float"), ("status", "int"), ("time", "float")]
# Semantic bounds per derived column (mirrors clean.SEMANTIC_BOUNDS)
_SEM = {"fga": (0.0, 1.0), "purity": (0.0, 100.0), "ploidy": (0.0, None), "tmb": (0.0, None),
        "mutation_count": (0.0, None), "time": (1e-3, None), "age": (0.0, 120.0)}


def _bounds_sql():
    parts = []
    for c, kind in _BOUND_COLS:
        lo, hi = f"min(CAST({c} AS DOUBLE))", f"max(CAST({c} AS DOUBLE))"
        if c in _SEM:
            slo, shi = _SEM[c]
            if slo is not None:
                lo = f"greatest({lo}, {slo}::DOUBLE)"
            if shi is not None:
                hi = f"least({hi}, {shi}::DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS dtype, {sql_r6(lo)} AS lo, {sql_r6(hi)} AS hi FROM ctrain""")
    return " UNION ALL ".join(parts)


@register("B20_column_bounds", with_ctes(*CLEAN_BASE, tail=_bounds_sql()))
def q_b20(spark, sf_dir):
    res = pipeline.clean_cohort(spark, sf_dir)
    tr = res.train.drop(*pipeline.HIDDEN)
    return round_floats(clean.column_metadata(tr, clean.SEMANTIC_BOUNDS, res.params["integer_columns"]))
