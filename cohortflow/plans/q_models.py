"""Queries for models, synthesis and the evaluation report
(E7-E13, E15, E16, F8-F10, F14, F15, F21, F23, F24, F26, G1, G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import hashing
from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import boosting, compare, evaluate, models, saved, survival, synth
from cohortflow.operators.hazard import DiscreteHazard
from cohortflow.plans.oracle import gap_sql, with_ctes
from cohortflow.plans.oracle_clean import CLEAN_SYN
from cohortflow.plans.q_metrics import _tables
from cohortflow.plans.q_more import q_a5
from cohortflow.plans.q_repair import FEATURES, NORM_SQL
from cohortflow.plans.registry import register
from cohortflow.schema import DEFAULT
from cohortflow.sources import io


def _cox(spark, sf_dir):
    from cohortflow.plans.cohort import memo

    real, _, _ = _tables(spark, sf_dir)
    return memo(("cox", id(spark), sf_dir), lambda: models.CoxPH(penalizer=0.01).fit(real, DEFAULT, FEATURES))


@register("E7_cox_fit")
def q_e7(spark, sf_dir):
    """Cox coefficients (Efron ties, ridge 0.01) on the real train split."""
    return round_floats(_cox(spark, sf_dir).params(spark))


@register("E8_cox_score")
def q_e8(spark, sf_dir):
    """Minus the partial hazard of the fitted Cox model on the real test split, and its C-index."""
    _, test, _ = _tables(spark, sf_dir)
    sc = _cox(spark, sf_dir).score(test)
    return round_floats(survival.concordance(sc, DEFAULT, "score"))


@register("E9_log_time_regressor")
def q_e9(spark, sf_dir):
    """Boosted trees (300 trees, depth 4) on log time; C-index on the real test split."""
    real, test, _ = _tables(spark, sf_dir)
    m = models.fit_log_time(real, DEFAULT, FEATURES, trees=300, depth=4)
    return round_floats(survival.concordance(models.predict_log_time(m, test, FEATURES), DEFAULT, "score"))


@register("E10_train_test_protocol")
def q_e10(spark, sf_dir):
    """TRTR / TSTR / TSTS C-index of the Cox model and of boosted trees for every synthetic method."""
    real, test, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.downstream(real, test, syn, DEFAULT, FEATURES, seed=42, trees=True))


@register("E11_survival_curve_model")
def q_e11(spark, sf_dir):
    """S(t | x) at 100 equally spaced horizons of a discrete-time hazard model of the real train split."""
    real, test, _ = _tables(spark, sf_dir)
    model = DiscreteHazard(100).fit(real, DEFAULT, FEATURES)
    s = model.survival(test.select("patient_id", *FEATURES))
    return round_floats(s.select("patient_id", *[F.col("surv")[i].alias(f"s{i}") for i in range(len(model.horizons))]))


@register("E12_E13_time_to_event")
def q_e12(spark, sf_dir):
    """Time-to-event fit (hazard curve features + boosted trees of depth 6) and
    seeded prediction with clamping for every synthetic row."""
    _, _, syn = _tables(spark, sf_dir)
    real, _, _ = _tables(spark, sf_dir)
    tte = models.TimeToEvent(trees=500, depth=6).fit(real, DEFAULT, FEATURES)
    p = tte.predict(syn, F.col("status"), F.concat_ws(":", "method", "patient_id"), seed=42)
    return round_floats(p.select("method", "patient_id", "status", "time", "pred_time", "clamped_low", "clamped_high"))


@register("E15_uncensor_times")
def q_e15(spark, sf_dir):
    """Censored real train rows take the predicted time (noise on, seeded)."""
    real, _, _ = _tables(spark, sf_dir)
    tte = models.TimeToEvent(trees=500, depth=6).fit(real, DEFAULT, FEATURES)
    p = tte.predict(real, F.col("status"), F.col("patient_id"), seed=42)
    return round_floats(models.uncensor(p, DEFAULT).select("patient_id", "status", "time"))


@register("E16_censoring_model")
def q_e16(spark, sf_dir):
    """Status classifier (depth 3) on the real train split; hard labels for the test split."""
    real, test, _ = _tables(spark, sf_dir)
    m = models.fit_censoring(real, DEFAULT, FEATURES, depth=3)
    p = models.predict_status(m, test.select("patient_id", *FEATURES, F.col("status").alias("true_status")),
                              FEATURES)
    return p.select("patient_id", "true_status", "status")


@register("F8_detection_auc")
def q_f8(spark, sf_dir):
    """k-fold AUC of boosted trees telling real train rows from each method."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.detection_auc(real, syn, FEATURES + ["time", "status"], folds=3))


@register("F8_detection_auc_mlp")
def q_f8_mlp(spark, sf_dir):
    """k-fold AUC of a perceptron (one hidden layer of 16) telling real train rows from each method."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.detection_auc(real, syn, FEATURES + ["time", "status"], folds=3, model="mlp"))


@register("F9_feature_rank_distance")
def q_f9(spark, sf_dir):
    """Spearman correlation of tree feature importances, real fit vs each method's fit."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.feature_rank_distance(real, syn, DEFAULT, FEATURES, trees=300))


@register("F21_projection_2d")
def q_f21(spark, sf_dir):
    """Standardise + PCA(2) of all rows, real and each method."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.projection_2d(real, syn, FEATURES))


@register("G1_synthesizer")
def q_g1(spark, sf_dir):
    """Conditional chain fitted on the real train split (copula covariates, E16 status, E13 time); as many rows, seed 42."""
    real, _, _ = _tables(spark, sf_dir)
    n = real.count()
    g = synth.ConditionalSynthesizer(DEFAULT, seed=42).fit(real, FEATURES, row_id="patient_id")
    return round_floats(g.generate(spark, n, seed=42))


@register("A6_save_load_models")
def q_a6_models(spark, sf_dir):
    """Cox, hazard and status models saved and loaded; their scores of the real test split, and whether they equal those before saving."""
    real, test, _ = _tables(spark, sf_dir)
    fitted = {"cox": _cox(spark, sf_dir), "hazard": DiscreteHazard(100).fit(real, DEFAULT, FEATURES),
              "status": models.fit_censoring(real, DEFAULT, FEATURES)}
    path = io.scratch_dir(spark, "models")
    saved.save_models(spark, fitted, path)

    def scored(m: dict):
        rows = m["hazard"].survival(m["cox"].score(test.select("patient_id", *FEATURES), "cox"), "surv")
        rows = boosting.predict(rows, m["status"], FEATURES, F.lit("all"), "p_event", loss="logistic")
        return rows.select("patient_id", "cox", F.element_at("surv", 50).alias("s50"), "p_event")

    after = scored(saved.load_models(spark, path))
    before = scored(fitted).toDF("patient_id", "b1", "b2", "b3")
    return after.join(before, "patient_id").select("patient_id", "cox", "s50", "p_event", (
        (F.col("cox") == F.col("b1")) & (F.col("s50") == F.col("b2")) & (F.col("p_event") == F.col("b3"))).alias("equal"))


_G3_SQL = with_ctes(*CLEAN_SYN, tail=f"""
SELECT patient_id,
  {sql_r6("sqrt(-2.0 * ln((('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|z:a|7'), 1, 8))::BIGINT + 0.5) / 4294967296.0))"
          " * cos(6.283185307179586 * (('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|z:b|7'), 1, 8))::BIGINT + 0.5) / 4294967296.0)")} AS z,
  {sql_r6("(('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|u|7'), 1, 8))::BIGINT + 0.5) / 4294967296.0")} AS u
FROM ctest""")


@register("G3_seeded_draws", _G3_SQL)
def q_g3(spark, sf_dir):
    """Hashed draws keyed by the real test ids, seed 7: the same under any partitioning."""
    _, test, _ = _tables(spark, sf_dir)
    t = test.repartition(3)
    return round_floats(t.select("patient_id", hashing.normal(F.col("patient_id"), "z", 7).alias("z"),
                                 hashing.uniform(F.col("patient_id"), "u", 7).alias("u")))


# ------------------------------------------------------------------ report ---

def _headline_metrics(spark, sf_dir):
    """Long metric table (method, vs, metric, value) of SQL-checkable metrics."""
    real, test, syn = _tables(spark, sf_dir)
    return evaluate.cheap_metrics(real, test, syn, DEFAULT)


_GAP_T = gap_sql("rt", "st", ["g"], ["method"])


def _metrics_sql():
    gap_train = _GAP_T.replace("km_r", "kmr_tr").replace("km_s", "kms_tr").replace("grid", "grid_tr") \
        .replace("t_r ", "tr_r ").replace("t_s ", "tr_s ").replace("tt ", "tt_tr ").replace("tt.", "tt_tr.") \
        .replace("g_r ", "gr_tr ").replace("g_rs", "grs_tr").replace("seg ", "seg_tr ").replace("integ", "integ_tr") \
        .replace("gap AS", "gap_tr AS")
    return [NORM_SQL, """rt AS (SELECT 0 AS g, time, status FROM ctest)""",
            """st AS (SELECT method, 0 AS g, time, status FROM csyn_n)""", _GAP_T.strip(),
            """mlong AS (
  SELECT method, 'test' AS vs, 'custom.optimism' AS metric, optimism AS value FROM gap
  UNION ALL SELECT method, 'test', 'custom.km_divergence', km_divergence FROM gap
  UNION ALL SELECT method, 'test', 'custom.short_sightedness', short_sightedness FROM gap
  UNION ALL SELECT s.method, 'test', 'custom.censoring_rate_diff', abs(s.e - r.e) FROM
    (SELECT method, avg(CAST(status AS DOUBLE)) AS e FROM csyn_n GROUP BY method) s, (SELECT avg(CAST(status AS DOUBLE)) AS e FROM ctest) r
  UNION ALL SELECT s.method, 'train', 'custom.censoring_rate_diff', abs(s.e - r.e) FROM
    (SELECT method, avg(CAST(status AS DOUBLE)) AS e FROM csyn_n GROUP BY method) s, (SELECT avg(CAST(status AS DOUBLE)) AS e FROM ctrain) r
)"""]


@register("F15_flatten_and_alias", with_ctes(*CLEAN_SYN, *_metrics_sql(), tail=f"""
SELECT method, 'Optimism (0=best)' AS headline, {sql_r6('value')} AS value, metric AS source_metric
FROM mlong WHERE vs = 'test' AND metric = 'custom.optimism' AND value IS NOT NULL
UNION ALL SELECT method, 'KM Divergence (0=best)', {sql_r6('value')}, metric FROM mlong
WHERE vs = 'test' AND metric = 'custom.km_divergence' AND value IS NOT NULL
UNION ALL SELECT method, 'Short-sightedness (0=best)', {sql_r6('value')}, metric FROM mlong
WHERE vs = 'test' AND metric = 'custom.short_sightedness' AND value IS NOT NULL"""))
def q_f15(spark, sf_dir):
    m = _headline_metrics(spark, sf_dir).where("vs = 'test'")
    out = compare.resolve_aliases(m, compare.alias_table(spark), keys=["method"])
    return round_floats(out)


register("A5_write_metrics", with_ctes(*CLEAN_SYN, *_metrics_sql(), tail=f"SELECT method, vs, metric, {sql_r6('value', 5)} AS value FROM mlong"))(q_a5)


@register("F24_method_comparison", with_ctes(*CLEAN_SYN, *_metrics_sql(), tail=f"""
SELECT method,
  {sql_r6("max(CASE WHEN vs = 'test' AND metric = 'custom.optimism' THEN value END)")} AS "test__custom.optimism",
  {sql_r6("max(CASE WHEN vs = 'test' AND metric = 'custom.km_divergence' THEN value END)")} AS "test__custom.km_divergence",
  {sql_r6("max(CASE WHEN vs = 'test' AND metric = 'custom.short_sightedness' THEN value END)")} AS "test__custom.short_sightedness",
  {sql_r6("max(CASE WHEN vs = 'test' AND metric = 'custom.censoring_rate_diff' THEN value END)")} AS "test__custom.censoring_rate_diff",
  {sql_r6("max(CASE WHEN vs = 'train' AND metric = 'custom.censoring_rate_diff' THEN value END)")} AS "train__custom.censoring_rate_diff"
FROM mlong GROUP BY method"""))
def q_f24(spark, sf_dir):
    m = _headline_metrics(spark, sf_dir)
    return round_floats(compare.method_comparison(
        m, ["custom.optimism", "custom.km_divergence", "custom.short_sightedness"]))


def _f23_sql():
    from cohortflow.plans.registry import ORACLES as _OR

    rep = _OR["F22_subgroup_report"]
    return f"""
WITH rep AS (SELECT * FROM ({rep}) x),
cell AS (SELECT method, cancer_type, {sql_r6('avg(km_divergence)')} AS mean_value FROM rep GROUP BY method, cancer_type),
gm AS (SELECT cancer_type, avg(km_divergence) AS g FROM rep GROUP BY cancer_type),
rk AS (SELECT cancer_type, CAST(row_number() OVER (ORDER BY g ASC NULLS LAST, cancer_type) AS INTEGER) AS column_rank FROM gm)
SELECT cell.method, cell.cancer_type, cell.mean_value, rk.column_rank FROM cell JOIN rk USING (cancer_type)"""


@register("F23_subgroup_pivot", _f23_sql())
def q_f23(spark, sf_dir):
    """Method x cancer type mean KM divergence, columns by ascending mean (long form with the column rank)."""
    from cohortflow.plans.registry import subgroup_report_query

    rep = subgroup_report_query(spark, sf_dir)
    return round_floats(compare.subgroup_long_means(rep, "km_divergence"))


@register("F14_metric_tiers")
def q_f14(spark, sf_dir):
    """All metric tiers incl. the opt-in privacy tier, failures isolated per metric (a row with the error)."""
    real, test, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.run_metrics(real, test, syn, DEFAULT, FEATURES, priv=True))


@register("F26_evaluate_methods")
def q_f26(spark, sf_dir):
    """Whole evaluation, vs train and vs test, pivoted to one row per method; a method that fails its preflight has
    that column only; a failed metric shows as a row "(failed)"."""
    real, test, syn = _tables(spark, sf_dir)
    long = evaluate.evaluate_methods(real, test, syn, DEFAULT, FEATURES)
    return round_floats(compare.method_comparison(long.withColumn("method", F.coalesce("method", F.lit("(failed)"))),
                                                  ["custom.optimism", "custom.km_divergence",
                                                   "custom.short_sightedness", "custom.cox_tstr"]))


@register("F10_downstream_utility")
def q_f10(spark, sf_dir):
    """Cox and tree utility for every method: TRTR / TSTR / TSTS C-index and Brier at the median time."""
    real, test, syn = _tables(spark, sf_dir)
    return round_floats(evaluate.downstream(real, test, syn, DEFAULT, FEATURES, seed=42,
                                            trees=True, tree_count=300, brier=True))
