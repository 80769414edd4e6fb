"""Evaluation protocol (E10, F8-F10, F14, F21, F26): model-based scores per
method, tiers with per-metric failure isolation, and the long metric table.

Loops here run over methods or folds -- a handful of model fits, each one a
distributed MLlib / Spark job; no row data passes through the driver.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.quantiles import median_map

from cohortflow.functions.hashing import hash32, keyed
from cohortflow.functions.windows import prefix_sum
from cohortflow.operators import boosting, clean, compare, cox, fidelity, models, privacy, sample, survival
from cohortflow.schema import DEFAULT, SurvivalSchema
from cohortflow.session import cut_lineage, materialize

METRIC_SCHEMA = "method string, vs string, metric string, value double, tier string, error string"


def _methods(syn: DataFrame, method: str = "method") -> list[str]:
    return sorted(r[method] for r in syn.select(method).distinct().collect())


def brier_weights(df: DataFrame, sch: SurvivalSchema, t_star: float) -> DataFrame:
    """``df`` with ``_alive`` (past t*) and ``_w``, the inverse-probability-of-censoring weight of its
    squared error at t*: 1 / G(T-) for events up to t*, 1 / G(t*) past it, 0 for the rest.

    G is the Kaplan-Meier curve of the censoring times (status flipped), from running sums over
    distinct times; it depends on the scored table only, not on what is scored.
    """
    t, e = F.col(sch.time), F.col(sch.status)
    per_t = df.groupBy(sch.time).agg(F.count(F.lit(1)).alias("n_t"), F.sum((1 - e).cast("long")).alias("c_t"))
    per_t = prefix_sum(per_t, [], [sch.time], ["n_t"], descending=True, out_prefix="_risk_")
    per_t = per_t.withColumn("_f", F.when(F.col("c_t") < F.col("_risk_n_t"),
                                          F.log1p(-F.col("c_t") / F.col("_risk_n_t"))).otherwise(F.lit(-1e300)))
    per_t = cut_lineage(prefix_sum(per_t, [], [sch.time], ["_f"], inclusive=False, out_prefix="_cum"))
    g_star = math.exp(max(-745.0, per_t.where(t <= t_star).agg(F.sum("_f")).first()[0] or 0.0))
    out = df.join(per_t.select(sch.time, F.exp("_cum_f").alias("_g")), sch.time)
    w = F.when(t > t_star, F.lit(1.0 / g_star if g_star > 0 else 0.0)).when((e == 1) & (F.col("_g") > 0), 1 / F.col("_g")).otherwise(F.lit(0.0))
    return out.withColumn("_alive", (t > t_star).cast("double")).withColumn("_w", w).drop("_g")


def brier_at(df: DataFrame, sch: SurvivalSchema, pred: str, t_star: float) -> float:
    """Inverse-probability-of-censoring weighted Brier score of S(t*) in ``pred``; NaN without rows."""
    score = F.avg(F.col("_w") * F.pow(F.col("_alive") - F.col(pred), 2))
    found = brier_weights(df, sch, t_star).agg(score).first()[0]
    return float("nan") if found is None else float(found)


def together(tasks: list, threads: int = 6) -> list:
    """Results of the functions ``tasks``, run as concurrent Spark jobs from driver
    threads: model fits are chains of short jobs that leave most cores idle."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    # A driver thread started by another call has no active session of its own.
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda f: inheritable_thread_target(spark)(f)(), tasks))


def capped(tables: DataFrame, max_n: int, id_col: str, seed: int, fit: str = "_fit") -> DataFrame:
    """At most ``max_n`` rows of every fit, the least hash(id, seed), written once."""
    return materialize(sample.hash_ranked(tables, id_col, seed, [fit]).where(F.col("_rank") <= max_n).drop("_rank"), "capped")


def residual_steps(fits: DataFrame, models_: dict, sch: SurvivalSchema, cols: Sequence[str]) -> DataFrame:
    """(_fit, _v: residual of log time, _lf, _z): the steps of the Kaplan-Meier curve of each fit's residuals,
    the baseline survival of boosted trees on log time; ln(1 - d/n), and 1 where the curve falls to 0."""
    res = models.predict_log_time(models_, fits, cols, "_pred", F.col("_fit")).select(
        "_fit", (models.log_time(sch) - F.col("_pred")).alias(sch.time), sch.status)
    n, d = F.col("n_at_risk").cast("double"), F.col("d").cast("double")
    km = survival.kaplan_meier(res, sch, ["_fit"])
    return cut_lineage(km.select("_fit", F.col(sch.time).alias("_v"), F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0)).alias("_lf"),
                                 F.when((d >= n) & (d > 0), F.lit(1)).otherwise(F.lit(0)).alias("_z")))


def residual_briers(scored: DataFrame, steps: DataFrame) -> dict[str, float]:
    """{fit: Brier score} of rows (_fit, _v, _w, _alive), each predicted by its fit's curve at ``_v``: steps and
    rows are summed by value, and one running sum over both gives every row its curve."""
    zero = F.lit(0.0)
    both = steps.select("_fit", "_v", "_lf", "_z", zero.alias("_a"), zero.alias("_b"), F.lit(0).alias("_n")).unionByName(
        scored.select("_fit", "_v", zero.alias("_lf"), F.lit(0).alias("_z"), (F.col("_w") * F.col("_alive")).alias("_a"), F.col("_w").alias("_b"), F.lit(1).alias("_n")))
    both = both.groupBy("_fit", "_v").agg(*[F.sum(c).alias(c) for c in ("_lf", "_z", "_a", "_b", "_n")])
    run = prefix_sum(both, ["_fit"], ["_v"], ["_lf", "_z"], out_prefix="_cum").where("_n > 0")
    s = F.when(F.col("_cum_z") > 0, F.lit(0.0)).otherwise(F.exp("_cum_lf"))
    error = F.col("_a") - 2 * s * F.col("_a") + s * s * F.col("_b")  # alive is 0 or 1
    return {r["_fit"]: r["v"] for r in run.groupBy("_fit").agg((F.sum(error) / F.sum("_n")).alias("v")).collect()}


def downstream(real_train: DataFrame, real_test: DataFrame, syn: DataFrame, sch: SurvivalSchema,
               cols: Sequence[str], max_n: int | None = None, seed: int = 42, trees: bool = True,
               tree_count: int = 300, brier: bool = False, id_col: str = "patient_id", on_train: bool = False) -> DataFrame:
    """TRTR, TSTR, TSTS C-index of Cox (and boosted trees) per
    method, fitted on and scored over all rows (``max_n``: train tables of that
    many rows by hash at most). Optional Brier scores at the median time: a Weibull AFT fit, and
    the trees with the Kaplan-Meier curve of their log residuals as baseline.
    ``on_train`` scores the same fits on the whole real train table as well
    (metrics ending in ``_id``).

    One Newton plan fits all Cox models and one job all trees; every scored table
    is stacked with (model, fit, table) keys and all C-indices come from one
    grouped concordance plan.
    """
    spark = real_train.sparkSession
    cols = list(cols)
    keep = [sch.time, sch.status]
    need = [id_col, *keep, *[c for c in cols if c not in keep]]
    refs = {"": cut_lineage(real_test.select(*need)), **({"_id": cut_lineage(real_train.select(*need))} if on_train else {})}
    syn = cut_lineage(syn.select("method", *need))
    methods = _methods(syn)
    own = real_train.select(F.lit("").alias("_fit"), *need).unionByName(syn.select(F.concat(F.lit("m:"), "method").alias("_fit"), *need))
    tables = materialize(own, "fits") if max_n is None else capped(own, max_n, id_col, seed)
    cox_models = cox.fit_many(tables, sch, cols, F.col("_fit"), 0.01)
    tree_models = models.fit_log_time(tables, sch, cols, trees=tree_count, fit=F.col("_fit"), id_col=id_col) if trees else {}

    # Every scored row with the fits that score it: real tables by all of them, a method by its own.
    fits = F.array(*[F.lit(f) for f in ["", *[f"m:{m}" for m in methods]]])
    scored = syn.select(F.lit("own").alias("_table"), F.concat(F.lit("m:"), "method").alias("_fit"), *need)
    for x, ref in refs.items():
        scored = scored.unionByName(ref.select(F.lit(f"ref{x}").alias("_table"), F.explode(fits).alias("_fit"), *need))
    linear = [(f, [float(b) / m.std[c] for b, c in zip(m.beta, cols)], -sum(float(b) * m.mean[c] / m.std[c] for b, c in zip(m.beta, cols)))
              for f, m in cox_models.items()]
    linear = spark.createDataFrame(linear, "_fit string, _b array<double>, _b0 double")  # one row a fit
    eta = F.col("_b0")
    for j, c in enumerate(cols):
        eta = eta + F.col(f"`{c}`").cast("double") * F.col("_b")[j]
    keys = ["_model", "_table", "_fit"]
    by_cox = scored.join(F.broadcast(linear), "_fit").select(F.lit("cox").alias("_model"), *keys[1:], *keep, (-F.exp(eta)).alias("score"))
    both = by_cox
    if trees:
        by_tree = models.predict_log_time(tree_models, scored, cols, fit=F.col("_fit"))
        both = by_cox.unionByName(by_tree.select(F.lit("xgb").alias("_model"), *keys[1:], *keep, "score"))
    found = {(r["_model"], r["_table"], r["_fit"]): r["c_index"] for r in survival.concordance(both, sch, "score", by=keys).collect()}
    rows = []
    for m in methods:
        for kind in ("cox", "xgb") if trees else ("cox",):
            for x in refs:
                rows.append((m, f"custom.{kind}_trtr{x}", found.get((kind, f"ref{x}", ""))))
                rows.append((m, f"custom.{kind}_tstr{x}", found.get((kind, f"ref{x}", f"m:{m}"))))
            rows.append((m, f"custom.{kind}_tsts", found.get((kind, "own", f"m:{m}"))))
    if brier:
        rows += _briers(refs, tables, methods, sch, cols, tree_models)
    return spark.createDataFrame([r for r in rows if r[2] is not None], "method string, metric string, value double")


def _briers(refs: dict, tables: DataFrame, methods: list[str], sch: SurvivalSchema, cols: list[str], tree_models: dict) -> list[tuple]:
    """(method, metric, Brier score at the median time of the reference) of AFT fits and of boosted trees."""
    spark = tables.sparkSession
    aft = together([lambda m=m: models.fit_aft(tables.where(F.col("_fit") == f"m:{m}"), sch, cols) for m in methods])
    params = spark.createDataFrame([(m, [float(v) for v in a.coefficients.toArray()], float(a.intercept), float(a.scale)) for m, a in zip(methods, aft)],
                                   "_m string, _b array<double>, _b0 double, _scale double")  # one row a method
    steps = residual_steps(tables, tree_models, sch, cols) if tree_models else None
    rows = []
    for x, ref in refs.items():
        t_star = median_map(ref, [sch.time])[sch.time]
        if t_star is None:
            continue
        weighted = brier_weights(ref, sch, t_star).join(F.broadcast(params))
        eta = F.col("_b0")
        for j, c in enumerate(cols):
            eta = eta + F.col(f"`{c}`").cast("double") * F.col("_b")[j]
        p = weighted.withColumn("aft", F.exp(-F.pow(F.lit(float(t_star)) / F.exp(eta), 1 / F.col("_scale")))).withColumn("_fit", F.concat(F.lit("m:"), "_m"))
        score = F.avg(F.col("_w") * F.pow(F.col("_alive") - F.col("aft"), 2)).alias("aft")
        rows += [(r["_m"], f"custom.brier_tstr_aft{x}", r["aft"]) for r in p.groupBy("_m").agg(score).collect()]
        if steps is not None:
            p = models.predict_log_time(tree_models, p, cols, "_pred", F.col("_fit"))
            p = p.withColumn("_v", F.lit(math.log(max(t_star, models.TIME_FLOOR))) - F.col("_pred"))
            found = residual_briers(p, steps)
            rows += [(m, f"custom.brier_tstr_xgb{x}", found.get(f"m:{m}")) for m in methods]
    return rows


def detection_auc(real: DataFrame, syn: DataFrame, cols: Sequence[str], folds: int = 3, trees: int = 20,
                  depth: int = 3, seed: int = 42, id_col: str = "patient_id", model: str = "gbt",
                  hidden: int = 16, max_iter: int = 50) -> DataFrame:
    """F8: k-fold AUC of a classifier telling real (0) from synthetic (1) rows:
    boosted trees (``model="gbt"``) or a one-hidden-layer perceptron on
    standardised features (``model="mlp"``); fold = hash(row id) mod k; AUC by
    the rank formula on the held-out fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from pyspark.ml.functions import vector_to_array

    spark = real.sparkSession
    real = cut_lineage(real.select(id_col, *cols))
    syn = cut_lineage(syn.select("method", id_col, *cols))
    methods = _methods(syn)
    fold = (hash32(keyed(F.concat(F.col(id_col).cast("string"), F.col("label").cast("string")), seed)) % folds).cast("int")

    def tree_aucs() -> dict:
        """All methods and folds at once: a row is learned from by the fits of the other folds."""
        both = real.withColumn("label", F.lit(0.0)).withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
        both = cut_lineage(both.unionByName(syn.withColumn("label", F.lit(1.0))).withColumn("fold", fold))
        others = F.array_remove(F.array(*[F.lit(f) for f in range(folds)]), F.col("fold"))
        learn = both.withColumn("_held", F.explode(others)).withColumn("_fit", F.concat_ws(":", F.col("_held").cast("string"), "method"))
        fitted = boosting.fit_many(learn, cols, F.col("label"), F.col("_fit"), F.concat_ws(":", F.col(id_col).cast("string"), F.col("label").cast("string")),
                                   loss="logistic", trees=trees, depth=depth, seed=seed)
        held = both.withColumn("_fit", F.concat_ws(":", F.col("fold").cast("string"), "method"))
        scored = boosting.predict(held, fitted, cols, F.col("_fit"), loss="logistic").where("score IS NOT NULL")
        return {(r["method"], r["fold"]): r["auc"] for r in compare.auc_rank(scored, "label", "score", ["method", "fold"]).collect()}

    def held_out_auc(m: str, f: int):
        both = real.withColumn("label", F.lit(0.0)).unionByName(
            syn.where(F.col("method") == m).drop("method").withColumn("label", F.lit(1.0))).withColumn("fold", fold)
        both = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(both)
        est = Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="_zf", withMean=True, withStd=True),
            MultilayerPerceptronClassifier(featuresCol="_zf", layers=[len(cols), hidden, 2],
                                           maxIter=max_iter, seed=seed)])
        pred = est.fit(both.where(F.col("fold") != f)).transform(both.where(F.col("fold") == f))
        pred = pred.select("label", vector_to_array("probability")[1].alias("score"))
        return compare.auc_rank(pred, "label", "score").first()["auc"]

    if model == "mlp":
        aucs = together([lambda m=m, f=f: held_out_auc(m, f) for m in methods for f in range(folds)])
    else:
        by_fold = tree_aucs() if methods else {}
        aucs = [by_fold.get((m, f)) for m in methods for f in range(folds)]
    name = "detection.detection_mlp.mean" if model == "mlp" else "detection.detection_xgb.mean"
    rows = []
    for k, m in enumerate(methods):
        good = [a for a in aucs[k * folds : (k + 1) * folds] if a is not None]
        rows.append((m, name, sum(good) / len(good) if good else None))
    auc = spark.createDataFrame(rows, "method string, metric string, value double")
    return compare.detection_verdict(auc, "value")


def feature_rank_distance(real: DataFrame, syn: DataFrame, sch: SurvivalSchema, cols: Sequence[str],
                          trees: int = 300, id_col: str = "patient_id") -> DataFrame:
    """Spearman correlation of boosted-tree feature importances (log-time
    regressor) fitted on real vs on each method. The importances are one
    number per feature, so the rank correlation is driver math on k values."""
    import numpy as np

    spark = real.sparkSession

    def ranks(v):
        order = np.argsort(v, kind="mergesort")
        r = np.empty(len(v))
        r[order] = np.arange(1, len(v) + 1)
        # average ties
        for val in set(v):
            idx = [i for i, x in enumerate(v) if x == val]
            if len(idx) > 1:
                r[idx] = np.mean(r[idx])
        return r

    need = list(dict.fromkeys([id_col, *cols, sch.time, sch.status]))
    syn = syn.select("method", *need)
    methods = _methods(syn)
    both = real.select(F.lit("").alias("_fit"), *need).unionByName(syn.select(F.concat(F.lit("m:"), "method").alias("_fit"), *need))
    fitted = models.fit_log_time(both, sch, cols, trees=trees, fit=F.col("_fit"), id_col=id_col)
    importances = [fitted[f].importances if f in fitted else np.zeros(len(cols)) for f in ["", *[f"m:{m}" for m in methods]]]
    imp_r = importances[0]
    rows = []
    for m, imp_s in zip(methods, importances[1:]):
        a, b = ranks(list(imp_r)), ranks(list(imp_s))
        rho = float(np.corrcoef(a, b)[0, 1]) if np.std(a) > 0 and np.std(b) > 0 else None
        rows.append((m, "performance.feat_rank_distance.corr", rho))
    return spark.createDataFrame(rows, "method string, metric string, value double")


def projection_2d(real: DataFrame, syn: DataFrame, cols: Sequence[str], id_col: str = "patient_id") -> DataFrame:
    """F21 (re-aimed from t-SNE): standardise, then PCA to 2 components over
    all rows of real and of every method."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = real.select(F.lit("real").alias("method"), id_col, *cols).unionByName(syn.select("method", id_col, *cols))
    v = VectorAssembler(inputCols=list(cols), outputCol="x", handleInvalid="keep").transform(both)
    sc = StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True).fit(v).transform(v)
    pc = PCA(k=2, inputCol="xs", outputCol="pc").fit(sc).transform(sc)
    a = vector_to_array("pc")
    return pc.select("method", id_col, a[0].alias("pc1"), a[1].alias("pc2"))


def cheap_metrics(real: DataFrame, test: DataFrame, syn: DataFrame, sch: SurvivalSchema = DEFAULT) -> DataFrame:
    """(method, vs, metric, value) for the survival gap vs test and the
    event-rate gap vs train and test -- the SQL-checkable headline subset."""
    s = clean.normalise_labels(syn, sch)
    gap = survival.survival_gap(test, s, sch, by=[], syn_keys=["method"])
    g = compare.metric_long(gap, ["method"], {"custom.optimism": "optimism",
                                              "custom.km_divergence": "km_divergence",
                                              "custom.short_sightedness": "short_sightedness"}, vs="test")
    out = g
    for vs, ref in (("test", test), ("train", real)):
        e = survival.event_rate_gap(ref, s, sch, by=[], syn_keys=["method"])
        out = out.unionByName(compare.metric_long(e, ["method"], {"custom.censoring_rate_diff": "censoring_rate_diff"},
                                                  vs=vs))
    return out


def _boot_long(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """(method, b, metric, value) replicate rows -> C8 summary in the long form: ``<name>.mean``
    plus ``.boot_mean/.boot_std/.boot_ci_lo/.boot_ci_hi/.boot_n``; ``names``: {metric: name}."""
    named = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    runs = runs.where(F.col("metric").isin(*names)).withColumn("metric", named[F.col("metric")])
    summ = sample.bootstrap_summary(runs, by=["method"])
    stats = {"mean": "boot_mean", "boot_mean": "boot_mean", "boot_std": "boot_std",
             "boot_ci_lo": "boot_ci_lo", "boot_ci_hi": "boot_ci_hi", "boot_n": "boot_n"}
    arr = F.array(*[F.struct(F.lit(k).alias("stat"), F.col(v).cast("double").alias("value")) for k, v in stats.items()])
    long = summ.select("method", "metric", F.explode(arr).alias("x"))
    return long.select("method", F.concat_ws(".", F.col("metric"), F.col("x.stat")).alias("metric"), F.col("x.value").alias("value"))


# Names of the replicates' figures in the metric table.
HEAVY_NAMES = {
    "precision": "stats.prdc.precision", "recall": "stats.prdc.recall", "density": "stats.prdc.density", "coverage": "stats.prdc.coverage",
    "delta_precision_alpha": "stats.alpha_precision.delta_precision_alpha_naive", "delta_coverage_beta": "stats.alpha_precision.delta_coverage_beta_naive",
    "authenticity": "stats.alpha_precision.authenticity_naive", "mmd_rbf": "stats.max_mean_discrepancy.joint",
}


def matched_pairs(ref: DataFrame, syn: DataFrame, id_col: str, seed: int) -> list[tuple[DataFrame, DataFrame]]:
    """C3 for every method: (reference rows, synthetic rows) of equal size, min(|ref|, |method|). Methods
    of equal size share a pair; the larger side keeps its least hashes (ranked once for all)."""
    n_ref = ref.count()
    sizes: dict[int, list[str]] = {}
    for r in syn.groupBy("method").count().collect():
        if r["method"] is not None:
            sizes.setdefault(min(n_ref, r["count"]), []).append(r["method"])
    if set(sizes) <= {n_ref} and n_ref and syn.count() == n_ref * sum(map(len, sizes.values())):
        return [(ref, syn)]
    a = cut_lineage(sample.hash_ranked(ref, id_col, seed))
    b = cut_lineage(sample.hash_ranked(syn, id_col, seed, ["method"]))
    return [(a.where(F.col("_rank") <= n).drop("_rank"), b.where(F.col("method").isin(*ms) & (F.col("_rank") <= n)).drop("_rank"))
            for n, ms in sorted(sizes.items())]


def run_metrics(real: DataFrame, test: DataFrame, syn: DataFrame, sch: SurvivalSchema, cols: Sequence[str],
                cheap: bool = True, heavy: bool = True, priv: bool = False, downstream_cox: bool = False,
                heavy_n_sub: int = 5000, heavy_n_bootstrap: int = 3,
                seed: int = 42, id_col: str = "patient_id", save_dir: str | None = None) -> DataFrame:
    """the evaluation tiers, vs the real train and the real test split.

    Each method is compared with each reference at equal size (C3).

    * always: optimism / KM divergence / short-sightedness, censoring-rate
      gap, time W1 for events and censored rows;
    * cheap: marginal JS distance, boosted-tree and perceptron detection AUC,
      Cox and tree performance with AFT and tree Brier scores (fitted once, scored
      on both references), feature-rank distance;
    * heavy: linear and RBF MMD, per-column and sliced joint W1 and inverse KL on
      all rows (all linear in rows here), and k-NN precision/recall/density/
      coverage, alpha-precision and exact RBF MMD on ``heavy_n_bootstrap`` hash
      subsamples of ``heavy_n_sub`` rows, summarised by C8;
    * privacy (opt-in, as in the reference): k-anonymity and l-diversity by
      classes and by clusters, identifiability of all rows.

    Each metric runs on its own; a failure becomes a row with ``error``
    instead of stopping the others. Results are per-method numbers, so each
    metric's small result is collected. With ``save_dir`` every metric overwrites
    its own folder there when it ends without error, and a later call with the
    same folder takes what is finished from it (A5).
    """
    from cohortflow.operators import neighbours

    spark = real.sparkSession
    all_cols = list(cols) + [sch.time, sch.status]
    real, test = cut_lineage(real), cut_lineage(test)  # every metric reads them
    s_norm = cut_lineage(clean.normalise_labels(syn, sch))
    tasks: list = []

    def run(tier, vs, name, fn, part: int = 0):
        folder = posixpath.join(save_dir, f"vs={vs}", f"{name}-{part}") if save_dir else None

        def rows_of() -> list[tuple]:
            if folder:
                try:  # the writer's commit leaves a whole table or none
                    return [tuple(r) for r in spark.read.schema(METRIC_SCHEMA).parquet(folder).collect()]
                except AnalysisException:
                    pass
            try:
                rows = [(r["method"], r["vs"] if "vs" in r.asDict() else vs, r["metric"] if "metric" in r.asDict() else name,
                         None if r["value"] is None else float(r["value"]), tier, None) for r in fn().collect()]
            except Exception as exc:  # noqa: BLE001  (isolation is the point)
                return [(None, vs, name, None, tier, f"{type(exc).__name__}: {str(exc)[:300]}")]
            if folder:
                spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
            return rows
        tasks.append(rows_of)

    def mean_over(df, col, metric):
        return df.groupBy("method").agg(F.avg(col).alias("value")).withColumn("metric", F.lit(metric))

    def named(df, col, metric):
        return df.select("method", F.lit(metric).alias("metric"), F.col(col).cast("double").alias("value"))

    def tiers(vs: str, ref: DataFrame, syn: DataFrame, part: int) -> None:
        again = lambda tier, name, fn: run(tier, vs, name, fn, part)
        again("custom", "custom.survival_gap", lambda: compare.metric_long(
            survival.survival_gap(ref, syn, sch, syn_keys=["method"]), ["method"],
            {"custom.optimism": "optimism", "custom.km_divergence": "km_divergence",
             "custom.short_sightedness": "short_sightedness"}))
        again("custom", "custom.censoring_rate_diff", lambda: compare.metric_long(
            survival.event_rate_gap(ref, syn, sch, syn_keys=["method"]), ["method"],
            {"custom.censoring_rate_diff": "censoring_rate_diff"}))
        again("custom", "custom.time_wass", lambda: fidelity.wasserstein_time(ref, syn, sch, ["method"])
              .select("method", F.concat(F.lit("custom.time_wass_"), F.col("subset")).alias("metric"),
                      F.col("w1").alias("value")))
        if cheap:
            again("cheap", "stats.jensenshannon_dist.marginal.mean",
                  lambda: mean_over(fidelity.jensen_shannon(ref, syn, all_cols, ["method"]),
                                    "js_distance", "stats.jensenshannon_dist.marginal.mean"))
            for model, name in (("gbt", "detection.detection_xgb.mean"), ("mlp", "detection.detection_mlp.mean")):
                again("cheap", name, lambda model=model: detection_auc(ref, syn, list(cols) + [sch.time], folds=3, model=model).drop("verdict"))
            again("cheap", "performance.feat_rank_distance.corr", lambda: feature_rank_distance(ref, syn, sch, cols))
        if heavy:
            again("heavy", "stats.max_mean_discrepancy.linear", lambda: named(
                fidelity.mmd_linear(ref, syn, all_cols, ["method"]), "mmd_linear", "stats.max_mean_discrepancy.linear"))
            again("heavy", "stats.max_mean_discrepancy.rbf", lambda: named(
                fidelity.mmd_rbf(ref, syn, all_cols, ["method"]), "mmd_rbf", "stats.max_mean_discrepancy.rbf"))
            again("heavy", "stats.wasserstein_dist.columns.mean",
                  lambda: mean_over(fidelity.wasserstein_columns(ref, syn, all_cols, ["method"]), "w1", "stats.wasserstein_dist.columns.mean"))
            again("heavy", "stats.wasserstein_dist.joint",
                  lambda: mean_over(fidelity.wasserstein_sliced(ref, syn, all_cols, ["method"]), "w1", "stats.wasserstein_dist.joint"))
            again("heavy", "stats.inv_kl_divergence.marginal.mean",
                  lambda: mean_over(fidelity.inverse_kl(ref, syn, all_cols, ["method"]),
                                    "inv_kl", "stats.inv_kl_divergence.marginal.mean"))
            again("heavy", "stats.replicates", lambda: _boot_long(
                neighbours.replicates(ref, syn, all_cols, heavy_n_sub, heavy_n_bootstrap, 5, seed, id_col), HEAVY_NAMES))
        if priv and vs == "train":
            def classes():
                both = ref.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
                k = privacy.k_anonymity(both, ["age", "sex", "ancestry"], ["method"])
                d = privacy.l_diversity(both, ["age", "sex", "ancestry"], "cancer_type", ["method"])
                return named(k, "k_anonymity", "privacy.k-anonymization").unionByName(named(d, "l_diversity", "privacy.l-diversity"))

            def by_clusters():
                both = ref.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
                c = cut_lineage(privacy.cluster_privacy(both, all_cols, "cancer_type", id_col=id_col))
                return named(c, "k_anonymity", "privacy.k-anonymization.clusters").unionByName(
                    named(c, "l_diversity", "privacy.l-diversity.clusters"))

            again("privacy", "privacy.classes", classes)
            again("privacy", "privacy.clusters", by_clusters)
            again("privacy", "privacy.identifiability_score", lambda: named(
                neighbours.identifiability(ref, syn, all_cols), "identifiability", "privacy.identifiability_score"))

    def performance() -> DataFrame:
        """Scores on the train table are vs train; ``custom`` names as well for ``downstream_cox``."""
        d = cut_lineage(downstream(real, test, s_norm, sch, cols, trees=True, brier=True, on_train=True))
        d = d.withColumn("vs", F.when(F.col("metric").endswith("_id"), "train").otherwise("test"))
        bare = F.regexp_replace("metric", "_id$", "")
        out = d.select("method", "vs", "value", F.regexp_replace(F.regexp_replace(F.regexp_replace(
            bare, r"^custom\.brier_tstr_xgb$", "performance.xgb.brier_tstr"), r"^custom\.(cox|brier)", "performance.linear_model.$1"),
            r"^custom\.xgb", "performance.xgb.xgb").alias("metric"))
        own = d.where("vs = 'test'").select("method", "vs", "value", "metric")
        return out.unionByName(own) if downstream_cox else out

    if cheap:
        run("cheap", "test", "performance", performance)
    elif downstream_cox:
        run("downstream", "test", "custom.cox", lambda: downstream(real, test, s_norm, sch, cols, trees=True, brier=True))
    for vs, ref, s in (("train", real, seed), ("test", test, seed + 1)):
        for part, (r, m) in enumerate(matched_pairs(ref, s_norm, id_col, s)):
            tiers(vs, r, m, part)
    return spark.createDataFrame([r for rows in together(tasks, threads=12) for r in rows], METRIC_SCHEMA)


def evaluate_methods(real: DataFrame, test: DataFrame, syn: DataFrame, sch: SurvivalSchema, cols: Sequence[str],
                     strict: bool = False, save_dir: str | None = None, **sizes) -> DataFrame:
    """preflight of every method, then the tiers of those that pass, as one long metric table.

    A method that fails its preflight (``strict``: also one with warnings) has the row
    ``preflight.passed`` = 0 and no metrics. ``save_dir`` as in ``run_metrics``.
    """
    checks = cut_lineage(compare.preflight(syn, real, sch, strict=strict).groupBy("method").agg(F.min(F.col("passed").cast("double")).alias("value")))
    passed = [r["method"] for r in checks.where("value = 1").collect()]
    long = checks.select("method", F.lit("train").alias("vs"), F.lit("preflight.passed").alias("metric"), "value",
                         F.lit("preflight").alias("tier"), F.lit(None).cast("string").alias("error"))
    if not passed:
        return long
    return long.unionByName(run_metrics(real, test, syn.where(F.col("method").isin(*passed)), sch, cols, downstream_cox=True, save_dir=save_dir, **sizes))
