"""Subgroup, cross-method and verdict reports.

Methods and groups are grouping keys, never Python loops: one job computes a
metric for every (method, group) at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe
from cohortflow.functions.quantiles import grouped_quantiles

from cohortflow.operators import clean, survival
from cohortflow.schema import DEFAULT, SurvivalSchema
from cohortflow.session import materialize


def top_groups(real: DataFrame, group: str, top_k: int = 12) -> list:
    """The ``top_k`` most frequent non-null groups of the real table (ties by value).

    A top-k report by design: at most ``top_k`` values reach the driver.
    """
    rows = (real.where(F.col(group).isNotNull()).groupBy(group).count()
            .orderBy(F.desc("count"), F.asc(group)).limit(top_k).collect())
    return [r[group] for r in rows]


def subgroup_report(real: DataFrame, syn_all: DataFrame, sch: SurvivalSchema = DEFAULT,
                    group: str = "cancer_type", method: str = "method", top_k: int = 12,
                    min_n: int = 50, n_grid: int = 500) -> DataFrame:
    """per method x top real group: n, optimism, KM divergence,
    short-sightedness, event rates and their gap; metrics null when either
    side has fewer than ``min_n`` rows.

    One plan for all methods and groups: KM curves are grouped by
    (method, group), the real curve by group only.
    """
    groups = top_groups(real, group, top_k)
    syn = clean.normalise_labels(syn_all, sch)
    lit_groups = F.array(*[F.lit(g) for g in groups]) if groups else F.array().cast(f"array<{real.schema[group].dataType.simpleString()}>")
    real_g = real.where(F.col(group).isin(groups))
    syn_g = syn.where(F.col(group).isin(groups))

    pairs = (syn.select(method).distinct()
             .select(method, F.explode(lit_groups).alias(group)))
    r_stats = real_g.groupBy(group).agg(F.count(F.lit(1)).cast("bigint").alias("n_real"),
                                        F.avg(F.col(sch.status).cast("double")).alias("real_event_rate"))
    s_stats = syn_g.groupBy(method, group).agg(F.count(F.lit(1)).cast("bigint").alias("n_syn"),
                                               F.avg(F.col(sch.status).cast("double")).alias("syn_event_rate"))
    base = (pairs.join(s_stats, [method, group], "left").join(r_stats, [group], "left")
            .withColumn("n_syn", F.coalesce("n_syn", F.lit(0)).cast("bigint"))
            .withColumn("n_real", F.coalesce("n_real", F.lit(0)).cast("bigint")))
    enough = (F.col("n_real") >= min_n) & (F.col("n_syn") >= min_n)

    # the gap of every (method, group) in one plan; pairs below min_n are
    # masked afterwards (cheaper than a semi-join that makes the curves wait
    # for the counts)
    gap = survival.survival_gap(real_g, syn_g, sch, by=[group], syn_keys=[method], n_grid=n_grid)
    out = base.join(gap, [method, group], "left")
    return out.select(
        method, F.col(group).cast("string").alias(group), "n_real", "n_syn",
        F.when(enough, F.col("optimism")).alias("optimism"),
        F.when(enough, F.col("km_divergence")).alias("km_divergence"),
        F.when(enough, F.col("short_sightedness")).alias("short_sightedness"),
        F.when(enough, F.abs(F.col("real_event_rate") - F.col("syn_event_rate"))).alias("censoring_rate_diff"),
        "real_event_rate", "syn_event_rate")


def subgroup_pivot(report: DataFrame, metric: str = "km_divergence", method: str = "method",
                   group: str = "cancer_type") -> DataFrame:
    """method x group mean of one metric, group columns by ascending mean.

    The column order comes from a small aggregate (one row per group).
    """
    order = (report.groupBy(group).agg(F.avg(metric).alias("m"))
             .orderBy(F.asc_nulls_last("m"), F.asc(group)).collect())
    cols = [r[group] for r in order]
    return report.groupBy(method).pivot(group, cols).agg(F.avg(metric))


def subgroup_long_means(report: DataFrame, metric: str = "km_divergence", method: str = "method",
                        group: str = "cancer_type") -> DataFrame:
    """F23 in long form: (method, group, mean, column rank by ascending group mean)."""
    cell = report.groupBy(method, group).agg(F.avg(metric).alias("mean_value"))
    gm = report.groupBy(group).agg(F.avg(metric).alias("_gm"))
    w = Window.orderBy(F.asc_nulls_last("_gm"), F.asc(group))
    gm = gm.withColumn("column_rank", F.row_number().over(w).cast("int"))
    return cell.join(gm.select(group, "column_rank"), group)


def detection_verdict(auc: DataFrame, col: str = "auc") -> DataFrame:
    """AUC < 0.6 good, < 0.75 borderline, else concerning."""
    a = F.col(col)
    return auc.withColumn("verdict", F.when(a.isNull(), F.lit(None))
                          .when(a < 0.6, F.lit("good"))
                          .when(a < 0.75, F.lit("borderline"))
                          .otherwise(F.lit("concerning")))


def preflight(syn_all: DataFrame, real: DataFrame, sch: SurvivalSchema = DEFAULT,
              method: str = "method", strict: bool = False) -> DataFrame:
    """F16: per method a (check, severity, detail) table and a pass flag.

    Rules: missing time/status -> fail; > 1 % null time or status -> warn;
    times outside [0.5 lo, 2 hi] of real: > 10 % fail, else any -> warn;
    q05..q95 spanning < 5 % of the real range -> fail (collapsed);
    non-binary status after rounding -> warn; event-rate gap > 0.15 -> warn.
    A failure blocks the metrics; warnings only under ``strict``.
    """
    spark = syn_all.sparkSession
    missing = [c for c in (sch.time, sch.status) if c not in syn_all.columns]
    if missing:
        ms = syn_all.select(method).distinct()
        return ms.select(method, F.lit("missing_column").alias("check"), F.lit("fail").alias("severity"),
                         F.lit(",".join(missing)).alias("detail"), F.lit(False).alias("passed"))
    rr = real.agg(F.min(sch.time).alias("r_lo"), F.max(sch.time).alias("r_hi"),
                  F.avg(F.col(sch.status).cast("double")).alias("r_ev")).first()
    r_lo, r_hi, r_ev = float(rr["r_lo"]), float(rr["r_hi"]), float(rr["r_ev"])
    t = nan_null(F.col(sch.time).cast("double"))
    s = nan_null(F.col(sch.status).cast("double"))
    s_round = F.bround(s, 0)
    s_clip = F.when(s_round < 0, 0.0).when(s_round > 1, 1.0).otherwise(s_round)
    st = syn_all.groupBy(method).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.isNull()).alias("na_t"), F.count_if(s.isNull()).alias("na_s"),
        F.count(t).alias("n_t"),
        F.count_if(t < r_lo * 0.5).alias("n_below"), F.count_if(t > r_hi * 2.0).alias("n_above"),
        F.count_if(s.isNotNull() & ~s_round.isin(0.0, 1.0)).alias("n_nonbinary"),
        F.avg(s_clip).alias("s_ev"))
    q = grouped_quantiles(syn_all, [method], [0.05, 0.95], value=sch.time)
    st = join_null_safe(st, q, [method], "left").select("*", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q95"))
    oob = F.col("n_below") + F.col("n_above")
    checks = F.array(
        F.struct(F.lit("null_time").alias("check"),
                 F.when(F.col("na_t") > 0.01 * F.col("n"), "warn").alias("severity"),
                 F.format_string("%d/%d null", F.col("na_t"), F.col("n")).alias("detail")),
        F.struct(F.lit("null_status").alias("check"),
                 F.when(F.col("na_s") > 0.01 * F.col("n"), "warn").alias("severity"),
                 F.format_string("%d/%d null", F.col("na_s"), F.col("n")).alias("detail")),
        F.struct(F.lit("time_range").alias("check"),
                 F.when(oob > 0.1 * F.col("n_t"), "fail").when(oob > 0, "warn").alias("severity"),
                 F.format_string("%d below, %d above", F.col("n_below"), F.col("n_above")).alias("detail")),
        F.struct(F.lit("time_collapsed").alias("check"),
                 F.when(F.col("q95") - F.col("q05") < 0.05 * (r_hi - r_lo), "fail").alias("severity"),
                 F.format_string("q05..q95 = %.3f..%.3f", F.col("q05"), F.col("q95")).alias("detail")),
        F.struct(F.lit("status_binary").alias("check"),
                 F.when(F.col("n_nonbinary") > 0, "warn").alias("severity"),
                 F.format_string("%d non-binary", F.col("n_nonbinary")).alias("detail")),
        F.struct(F.lit("event_rate").alias("check"),
                 F.when(F.abs(F.col("s_ev") - r_ev) > 0.15, "warn").alias("severity"),
                 F.format_string("real=%.3f syn=%.3f", F.lit(r_ev), F.col("s_ev")).alias("detail")),
    )
    long = st.select(method, F.explode(checks).alias("c")).select(method, "c.*")
    long = long.withColumn("severity", F.coalesce("severity", F.lit("ok")))
    bad = F.max(F.when(F.col("severity") == "fail", 1).when(
        F.lit(strict) & (F.col("severity") == "warn"), 1).otherwise(0)).over(Window.partitionBy(method))
    return long.withColumn("passed", bad == 0)


def nan_null(c):
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def resolve_aliases(metrics: DataFrame, aliases: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """for every headline name the first non-null metric among its
    candidates (lowest priority number). ``metrics``: (keys..., metric, value);
    ``aliases``: (headline, metric, priority), a small literal table."""
    j = metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(aliases), "metric")
    return j.groupBy(*keys, "headline").agg(F.min_by("value", "priority").alias("value"),
                                            F.min_by("metric", "priority").alias("source_metric"))


def method_comparison(metrics: DataFrame, headline: Sequence[str], method: str = "method",
                      vs: str = "vs") -> DataFrame:
    """one row per method, ``<vs>__<metric>`` columns; headline metrics first.

    A pivot over a known column list; the metrics, some rows a method, are written
    first, so that listing the columns does not compute them once more."""
    m = materialize(metrics.withColumn("_col", F.concat(F.col(vs), F.lit("__"), F.col("metric"))), "metrics")
    names = [r["_col"] for r in m.select("_col").distinct().orderBy("_col").collect()]
    head = [n for h in headline for n in names if n.endswith("__" + h)]
    rest = [n for n in names if n not in head]
    wide = m.groupBy(method).pivot("_col", head + rest).agg(F.first("value"))
    return wide.select(method, *[F.col(f"`{n}`") for n in head + rest])


# Headline metric names and their candidate keys, first match wins
# (priority in list order). Keys name our metric long table.
KEY_ALIASES = {
    "JSD (lower=better)": [
        "stats.jensenshannon_dist.marginal.mean",
        "stats.jensenshannon_dist.mean",
        "stats.jensenshannon_dist.joint.mean",
    ],
    "Precision": ["stats.prdc.precision.mean", "performance.prdc.precision.mean"],
    "Recall": ["stats.prdc.recall.mean", "performance.prdc.recall.mean"],
    "Detection AUC XGB (0.5=best)": ["detection.detection_xgb.mean.mean", "detection.detection_xgb.mean"],
    "Detection AUC MLP (0.5=best)": ["detection.detection_mlp.mean.mean", "detection.detection_mlp.mean"],
    "Downstream C-Index (TSTR, syn→real)": [
        "performance.xgb.syn_ood.mean", "performance.xgb.syn_ood", "custom.xgb_tstr", "custom.cox_tstr"],
    "Feat. importance corr": [
        "performance.feat_rank_distance.corr.mean", "performance.feat_rank_distance.corr",
        "custom.feat_imp_spearman"],
    "Optimism (0=best)": ["custom.optimism"],
    "KM Divergence (0=best)": ["custom.km_divergence"],
    "Short-sightedness (0=best)": ["custom.short_sightedness"],
}


def alias_table(spark) -> DataFrame:
    rows = [(h, m, i) for h, ms in KEY_ALIASES.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "headline string, metric string, priority int")


def auc_rank(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC by the rank formula (ties get average ranks):
    (sum of positive ranks - n1 (n1 + 1) / 2) / (n1 n0).

    Ranks come from a distributed prefix count over distinct scores, so one
    group never lands in a single task."""
    from cohortflow.functions.windows import prefix_sum

    by = list(by)
    cells = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"),
                                       F.sum(F.col(label).cast("long")).alias("_p"))
    cells = prefix_sum(cells, by, [score], ["_n"], inclusive=False, out_prefix="_b")
    rank = F.col("_b_n") + (F.col("_n") + 1) / 2.0
    agg = cells.groupBy(*by).agg(F.sum(F.col("_p") * rank).alias("_rs"), F.sum("_p").alias("_n1"),
                                 F.sum(F.col("_n") - F.col("_p")).alias("_n0"))
    auc = (F.col("_rs") - F.col("_n1") * (F.col("_n1") + 1) / 2.0) / (F.col("_n1") * F.col("_n0"))
    return agg.select(*by, F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), auc).alias("auc"))


def metric_long(df: DataFrame, keys: Sequence[str], metric_cols: dict[str, str], vs: str | None = None) -> DataFrame:
    """Wide metric columns -> (keys..., [vs], metric, value)."""
    arr = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
                    for name, c in metric_cols.items()])
    out = df.select(*keys, F.explode(arr).alias("_m")).select(*keys, "_m.metric", "_m.value")
    return out.withColumn("vs", F.lit(vs)) if vs is not None else out
