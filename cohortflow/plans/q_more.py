"""Queries for sampling, encoders, AUC/verdict, alias resolution, comparison and IO
(A3, A7, C3, C5-C8, D1, D4, D9, F15, F17, F23, F24, G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import hashing
from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import compare, encode, sample
from cohortflow.operators.fidelity import stack
from cohortflow.plans import pipeline
from cohortflow.plans.oracle import with_ctes
from cohortflow.plans.oracle_clean import CLEAN_SYN
from cohortflow.plans.q_metrics import COLS, _tables, stack_sql
from cohortflow.plans.q_repair import FEATURES
from cohortflow.plans.registry import register
from cohortflow.schema import DEFAULT
from cohortflow.sources import io

U = "((('0x' || substr(md5(CAST({k} AS VARCHAR) || '|{s}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def u_sql(k, s):
    return U.format(k=k, s=s)


# ------------------------------------------------------------------ C --------

@register("C3_match_size", with_ctes(*CLEAN_SYN, """
n AS (SELECT method, least((SELECT count(*) FROM ctest), count(*)) AS n FROM csyn GROUP BY method)""",
    tail=f"""
SELECT 'real' AS side, method, patient_id
FROM (SELECT patient_id, row_number() OVER (ORDER BY {u_sql('patient_id', 42)}, patient_id) AS rn FROM ctest), n WHERE rn <= n
UNION ALL
SELECT 'syn', method, patient_id
FROM (SELECT method, patient_id, row_number() OVER (PARTITION BY method ORDER BY {u_sql('patient_id', 42)}, patient_id) AS rn FROM csyn)
JOIN n USING (method) WHERE rn <= n"""))
def q_c3(spark, sf_dir):
    _, test, syn = _tables(spark, sf_dir)
    a, b = sample.match_sizes(test, syn, "patient_id", "patient_id", 42)
    return a.select(F.lit("real").alias("side"), "method", "patient_id").unionByName(
        b.select(F.lit("syn").alias("side"), "method", "patient_id"))


@register("C5_cap_rows", with_ctes(*CLEAN_SYN, tail=f"""
SELECT method, patient_id FROM (
  SELECT method, patient_id, row_number() OVER (ORDER BY {u_sql("method || ':' || patient_id", 7)}, method || ':' || patient_id) AS rn
  FROM csyn) WHERE rn <= 5000"""))
def q_c5(spark, sf_dir):
    _, _, syn = _tables(spark, sf_dir)
    s = syn.withColumn("_rid", F.concat_ws(":", "method", F.col("patient_id").cast("string")))
    return sample.cap_rows(s, 5000, "_rid", 7).select("method", "patient_id")


@register("C6_balanced_weights", with_ctes(*CLEAN_SYN, tail=f"""
SELECT status, CAST(least(floor(time / 12.0), 9) AS INTEGER) AS time_bin, count(*)::BIGINT AS n,
       {sql_r6('1.0 / count(*)')} AS weight
FROM ctrain GROUP BY ALL"""))
def q_c6(spark, sf_dir):
    real, _, _ = _tables(spark, sf_dir)
    lab = real.withColumn("time_bin", F.least(F.floor(F.col("time") / 12.0), F.lit(9)).cast("int"))
    return round_floats(sample.balanced_weights(lab, ["status", "time_bin"]))


@register("C6_balanced_resample", with_ctes(*CLEAN_SYN, f"""
lab AS (SELECT patient_id, status, CAST(least(floor(time / 12.0), 9) AS INTEGER) AS time_bin FROM ctrain),
cls AS (SELECT status, time_bin, n, row_number() OVER (ORDER BY status, time_bin) - 1 AS c, count(*) OVER () AS k
        FROM (SELECT status, time_bin, count(*) AS n FROM lab GROUP BY ALL)),
ranked AS (SELECT patient_id, status, time_bin,
                  row_number() OVER (PARTITION BY status, time_bin ORDER BY {u_sql("patient_id", 42)}, patient_id) - 1 AS r FROM lab),
slots AS (SELECT j AS slot, CAST(floor({u_sql("j", "balanced:class|42")} * (SELECT max(k) FROM cls)) AS BIGINT) AS c,
                 {u_sql("j", "balanced:row|42")} AS u FROM range(0, 20000) g(j))""", tail="""
SELECT slot, patient_id, ranked.status, ranked.time_bin
FROM slots JOIN cls USING (c)
JOIN ranked ON ranked.status = cls.status AND ranked.time_bin = cls.time_bin AND ranked.r = CAST(floor(u * n) AS BIGINT)"""))
def q_c6_resample(spark, sf_dir):
    real, _, _ = _tables(spark, sf_dir)
    lab = real.withColumn("time_bin", F.least(F.floor(F.col("time") / 12.0), F.lit(9)).cast("int"))
    return sample.balanced_resample(lab, ["status", "time_bin"], 20000, "patient_id", 42).select(
        "slot", "patient_id", "status", "time_bin")



@register("C7_cycle_conditional", with_ctes(*CLEAN_SYN, """
idx AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS src FROM ctest)""",
    """m AS (SELECT count(*) AS m FROM ctest)""", tail="""
SELECT r.i AS row_idx, idx.patient_id FROM range(0, (SELECT 2 * m + 7 FROM m)) r(i), m JOIN idx ON idx.src = r.i % m.m"""))
def q_c7(spark, sf_dir):
    _, test, _ = _tables(spark, sf_dir)
    n = 2 * test.count() + 7
    return sample.cycle(test.select("patient_id"), n, ["patient_id"]).select("row_idx", "patient_id")


_B = 5


@register("C8_bootstrap_summary", with_ctes(*CLEAN_SYN, f"""
runs AS (
  SELECT b, 'event_rate' AS metric, avg(CAST(status AS DOUBLE)) AS value FROM ctest, range(0, {_B}) r(b)
  WHERE {u_sql("CAST(patient_id AS VARCHAR) || '|' || CAST(b AS VARCHAR)", 'boot')} < 0.5 GROUP BY b
  UNION ALL
  SELECT b, 'mean_time', avg(time) FROM ctest, range(0, {_B}) r(b)
  WHERE {u_sql("CAST(patient_id AS VARCHAR) || '|' || CAST(b AS VARCHAR)", 'boot')} < 0.5 GROUP BY b)""", tail=f"""
SELECT metric, {sql_r6('avg(value)')} AS boot_mean, {sql_r6('coalesce(stddev_samp(value), 0.0)')} AS boot_std,
       {sql_r6('quantile_cont(value, 0.025)')} AS boot_ci_lo, {sql_r6('quantile_cont(value, 0.975)')} AS boot_ci_hi,
       count(value)::BIGINT AS boot_n
FROM runs GROUP BY metric"""))
def q_c8(spark, sf_dir):
    """B half-samples of the real test split, one metric pass over all replicates."""
    _, test, _ = _tables(spark, sf_dir)
    rep = test.select("patient_id", "status", "time", F.explode(F.sequence(F.lit(0), F.lit(_B - 1))).alias("b"))
    key = F.concat(F.col("patient_id").cast("string"), F.lit("|"), F.col("b").cast("string"))
    rep = rep.where((hashing.hash32(F.concat(key, F.lit("|boot"))) + 0.5) / hashing.TWO_32 < 0.5)
    runs = rep.groupBy("b").agg(F.avg(F.col("status").cast("double")).alias("event_rate"),
                                F.avg("time").alias("mean_time"))
    long = compare.metric_long(runs, ["b"], {"event_rate": "event_rate", "mean_time": "mean_time"})
    return round_floats(sample.bootstrap_summary(long))


# ------------------------------------------------------------------ D --------

@register("D1_discrete_columns", with_ctes(*CLEAN_SYN, f"""
rs AS ({stack_sql('ctrain', COLS)})""", tail="""
SELECT "column", CASE WHEN count(DISTINCT value) <= 10 THEN count(DISTINCT value) END::BIGINT AS n_distinct,
       count(DISTINCT value) <= 10 AS is_discrete
FROM rs GROUP BY "column\""""))
def q_d1(spark, sf_dir):
    real, _, _ = _tables(spark, sf_dir)
    return encode.discrete_columns(real, COLS, limit=10)


@register("D9_time_horizons", with_ctes(*CLEAN_SYN, tail=f"""
SELECT i, {sql_r6('CASE WHEN i = 99 THEN hi ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / 99.0) END')} AS horizon
FROM (SELECT min(time) AS lo, max(time) AS hi FROM ctrain), range(0, 100) r(i)"""))
def q_d9(spark, sf_dir):
    real, _, _ = _tables(spark, sf_dir)
    return round_floats(encode.time_horizons(real, DEFAULT, 100))


@register("D4_one_hot", with_ctes(*CLEAN_SYN, """
cats AS (SELECT DISTINCT subgroup AS v FROM ctrain)""", tail="""
SELECT t.patient_id, c.v AS category, CAST(t.subgroup = c.v AS INTEGER) AS hot FROM ctest t, cats c"""))
def q_d4(spark, sf_dir):
    """One-hot of the subgroup code (categories fitted on train), in long form."""
    real, test, _ = _tables(spark, sf_dir)
    cats = encode.fit_categories(real, ["subgroup"])
    wide = encode.one_hot(test.select("patient_id", "subgroup"), cats)
    arr = F.array(*[F.struct(F.lit(int(v)).cast("bigint").alias("category"), F.col(f"{c}__{i}").alias("hot"))
                    for c, i, v in encode.one_hot_layout(cats)])
    return wide.select("patient_id", F.explode(arr).alias("x")).select("patient_id", "x.category", "x.hot")


# ------------------------------------------------------------------ F --------

@register("F17_detection_verdict", with_ctes(*CLEAN_SYN, f"""
lab AS (SELECT method, "column", 0 AS label, value AS score FROM ({stack_sql('ctrain', COLS)}), (SELECT DISTINCT method FROM csyn)
        UNION ALL SELECT method, "column", 1, value FROM ({stack_sql('csyn', COLS, 'method')}))""", """
rk AS (SELECT method, "column", label, (rank() OVER (PARTITION BY method, "column" ORDER BY score) - 1)
              + (count(*) OVER (PARTITION BY method, "column", score) + 1) / 2.0 AS r FROM lab)""", """
au AS (SELECT method, "column", (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
                      / (count_if(label = 1) * count_if(label = 0)) AS auc FROM rk GROUP BY method, "column")""", tail=f"""
SELECT method, "column", {sql_r6('auc')} AS auc,
       CASE WHEN auc < 0.6 THEN 'good' WHEN auc < 0.75 THEN 'borderline' ELSE 'concerning' END AS verdict FROM au"""))
def q_f17(spark, sf_dir):
    """Single-feature detection AUC of every column (real = 0, synthetic = 1) and its verdict."""
    real, _, syn = _tables(spark, sf_dir)
    lab = stack(syn, COLS, ["method"]).select("method", "column", F.lit(1).alias("label"), F.col("value").alias("score"))
    # the method names are a handful of table names: a parameter list
    m = [row["method"] for row in syn.select("method").distinct().collect()]
    real_lab = stack(real, COLS).select(F.explode(F.array(*[F.lit(x) for x in m])).alias("method"), "column",
                                        F.lit(0).alias("label"), F.col("value").alias("score"))
    auc = compare.auc_rank(real_lab.unionByName(lab), "label", "score", by=["method", "column"])
    return round_floats(compare.detection_verdict(auc, "auc"))


# ------------------------------------------------------------------ D2-D7 ----

_K = 3
_QS = [(j + 0.5) / _K for j in range(_K)] + [0.1, 0.9]
_CONT = ["age", "mutation_count", "tmb", "fga", "purity", "ploidy", "time"]
_ENC = _CONT


def _init_sql(cols, k=_K):
    qs = [(j + 0.5) / k for j in range(k)] + [0.1, 0.9]
    ql = "[" + ", ".join(repr(q) for q in qs) + "]"
    return f"""
q AS (SELECT "column", quantile_cont(value, {ql}) AS q FROM ({stack_sql('ctrain', cols)}) GROUP BY "column"),
p AS (SELECT "column", CAST(j AS INTEGER) AS comp, {repr(1.0 / k)}::DOUBLE AS weight, q[j + 1] AS mu,
             greatest((q[{k + 2}] - q[{k + 1}]) / {2.0 * k}::DOUBLE, 1e-6::DOUBLE) AS sigma FROM q, range(0, {k}) r(j))"""


def _enc_sql(src, cols):
    return f"""
xs AS ({stack_sql(src, cols, 'patient_id')}),
sc AS (SELECT xs.patient_id, xs."column", xs.value, p.comp, p.mu, p.sigma,
              (ln(p.weight) - ln(p.sigma)) - pow(xs.value - p.mu, 2) / (2.0 * p.sigma * p.sigma) AS score
       FROM xs JOIN p USING ("column")),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, "column" ORDER BY score DESC, comp) AS rn
                        FROM sc) WHERE rn = 1),
enc AS (SELECT patient_id, "column", value, comp, mu, sigma,
               (least(greatest((value - mu) / (4.0 * sigma), -0.99), 0.99) + 1.0) / 2.0 AS norm FROM best)"""


def _enc_spark(spark, sf_dir, cols=_ENC, k=_K):
    real, test, _ = _tables(spark, sf_dir)
    params = encode.init_modes(real, cols, k)
    return test, params


@register("D2_mode_encode", with_ctes(*CLEAN_SYN, _init_sql(_ENC).strip(), _enc_sql("ctest", _ENC).strip(), tail=f"""
SELECT patient_id, "column", comp, {sql_r6('norm')} AS norm FROM enc"""))
def q_d2(spark, sf_dir):
    """Mode-specific normalisation with fixed quantile-initialised modes (exact oracle)."""
    test, params = _enc_spark(spark, sf_dir)
    e = encode.mode_encode(test.select("patient_id", *_ENC), params, _ENC)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__comp").cast("int").alias("comp"),
                             F.col(f"{c}__norm").alias("norm")) for c in _ENC])
    return round_floats(e.select("patient_id", F.explode(arr).alias("x")).select("patient_id", "x.*"))


@register("D3_mode_decode", with_ctes(*CLEAN_SYN, _init_sql(_ENC).strip(), _enc_sql("ctest", _ENC).strip(), tail=f"""
SELECT patient_id, "column", {sql_r6('(norm * 2.0 - 1.0) * (4.0 * sigma) + mu')} AS value FROM enc"""))
def q_d3(spark, sf_dir):
    test, params = _enc_spark(spark, sf_dir)
    e = encode.mode_encode(test.select("patient_id", *_ENC), params, _ENC)
    d = encode.mode_decode(e.drop(*_ENC), params, _ENC)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in _ENC])
    return round_floats(d.select("patient_id", F.explode(arr).alias("x")).select("patient_id", "x.*"))


_BIN = _CONT
_CODES = [c for c in FEATURES if c not in _CONT] + ["status"]


_WIDE = ", ".join(f"""max(CASE WHEN "column" = '{c}' THEN comp END) AS {c}""" for c in _BIN)


@register("D6_bin_encode", with_ctes(*CLEAN_SYN, _init_sql(_BIN, 2).strip(), _enc_sql("ctest", _BIN).strip(), tail="""
SELECT patient_id, """ + _WIDE + ", " + ", ".join(f"any_value(t.{c}) AS {c}" for c in _CODES) + """
FROM enc JOIN (SELECT patient_id, """ + ", ".join(_CODES) + """ FROM ctest) t USING (patient_id) GROUP BY patient_id"""))
def q_d6(spark, sf_dir):
    real, test, _ = _tables(spark, sf_dir)
    params = encode.init_modes(real, _BIN, 2)
    return encode.bin_encode(test.select("patient_id", *_BIN, *_CODES), params, _BIN)


_COND = ["time", "status"] + FEATURES


@register("D7_survival_condition", with_ctes(*CLEAN_SYN, _init_sql(_BIN, 2).strip(), _enc_sql("ctest", _BIN).strip(), f"""
b AS (SELECT patient_id, {_WIDE} FROM enc GROUP BY patient_id)""", f"""
w AS (SELECT b.*, {", ".join(f"t.{c}" for c in _CODES)} FROM b JOIN ctest t USING (patient_id))""", tail=f"""
SELECT patient_id, concat_ws('|', {", ".join(_COND)}) AS cell, f.feature, f.level FROM w,
  LATERAL ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(w.{c} AS BIGINT) AS level" for c in _COND)}) f"""))
def q_d7(spark, sf_dir):
    real, test, _ = _tables(spark, sf_dir)
    params = encode.init_modes(real, _BIN, 2)
    return encode.survival_condition(test, params, _BIN, _COND, "patient_id")


def q_d2_fit(spark, sf_dir):
    """Variational mixture of all seven continuous columns; rows-only (iterative fit)."""
    real, _, _ = _tables(spark, sf_dir)
    return round_floats(encode.fit_modes(real, _CONT, k=10))


def q_d5(spark, sf_dir):
    """Tabular encode -> decode round trip of the clean test split (rows-only:
    the modes come from an iterative fit)."""
    real, test, _ = _tables(spark, sf_dir)
    cols = FEATURES + ["time", "status"]
    enc = encode.TabularEncoder(k=10, limit=10).fit(real, cols)
    z = enc.transform(test.select("patient_id", *cols))
    return round_floats(enc.inverse(z))


register("D2_fit_modes")(q_d2_fit)
register("D5_tabular_encode")(q_d5)


# ------------------------------------------------------------------ A --------

@register("A7_align_columns", with_ctes(*CLEAN_SYN, tail=f"""
SELECT method, patient_id, age, ancestry, cancer_type, subgroup, sex, msi_type, {sql_r6('mutation_count')} AS mutation_count,
       {sql_r6('tmb')} AS tmb, {sql_r6('purity')} AS purity, status, {sql_r6('time')} AS time
FROM csyn"""))
def q_a7(spark, sf_dir):
    """A synthetic table without fga and ploidy aligned to the real columns."""
    real, _, syn = _tables(spark, sf_dir)
    partial = syn.drop("fga", "ploidy")
    _, s, common, missing = io.align_columns(real.drop("h", "patient_id"), partial, keep=["method", "patient_id"])
    assert missing == ["fga", "ploidy"], missing
    return round_floats(s)


def q_a3(spark, sf_dir):
    """B20 metadata written as a JSON sidecar next to the train table and found from the table's path."""
    from cohortflow.plans.q_clean import q_b20

    real, _, _ = _tables(spark, sf_dir)
    folder = io.scratch_dir(spark, "metadata")
    train = io.write_cohort(real, f"{folder}/train.parquet")
    io.write_metadata(q_b20(spark, sf_dir), f"{folder}/train_metadata.json", "time", "status",
                      pipeline.clean_cohort(spark, sf_dir).params["integer_columns"])
    return io.find_metadata(spark, train).select("column", "dtype", "lo", "hi")


def q_a4(spark, sf_dir):
    """One ``<method>.csv`` a method in a flat folder, read back with the method from the stem."""
    _, _, syn = _tables(spark, sf_dir)
    path = io.scratch_dir(spark, "methods")
    for m in sorted(r["method"] for r in syn.select("method").distinct().collect()):
        io.write_cohort(syn.where(F.col("method") == m).select("patient_id", "status", "time"), f"{path}/{m}.csv", "csv")
    back = io.read_methods(spark, path, "csv", schema="patient_id bigint, status int, time double")
    return round_floats(back.select("method", "patient_id", "status", "time"))


from cohortflow.plans.registry import ORACLES as _OR  # noqa: E402

register("A3_column_metadata_io", _OR["B20_column_bounds"])(q_a3)
register("A4_read_methods", with_ctes(*CLEAN_SYN, tail=f"""
SELECT method, patient_id, status, {sql_r6('time')} AS time FROM csyn"""))(q_a4)


@register("A2_write_cohort", with_ctes(*CLEAN_SYN, tail=f"""
SELECT patient_id, CAST(status AS INTEGER) AS status, {sql_r6('time')} AS time, 'train' AS split FROM ctrain
UNION ALL SELECT patient_id, CAST(status AS INTEGER), {sql_r6('time')}, 'test' FROM ctest"""))
def q_a2(spark, sf_dir):
    """Clean train and test written as Parquet (and the test split as CSV) and read back."""
    from cohortflow.plans.q_repair import FEATURES as _F

    real, test, _ = _tables(spark, sf_dir)
    p1, p2 = io.scratch_dir(spark, "train"), io.scratch_dir(spark, "test_csv")
    io.write_cohort(real, p1, "parquet")
    io.write_cohort(test.select("patient_id", *_F, "status", "time"), p2, "csv")
    schema = ", ".join(["patient_id bigint"] + [f"{c} {test.schema[c].dataType.simpleString()}" for c in _F]
                       + ["status int", "time double"])
    a = io.read_cohort(spark, p1, fmt="parquet").select("patient_id", "status", "time").withColumn("split", F.lit("train"))
    b = io.read_cohort(spark, p2, schema=schema, fmt="csv").select("patient_id", "status", "time") \
        .withColumn("split", F.lit("test"))
    return round_floats(a.unionByName(b))


def q_a5(spark, sf_dir):
    """The long metric table appended under (method, vs) partitions and read back."""
    from cohortflow.operators import evaluate

    real, test, syn = _tables(spark, sf_dir)
    m = evaluate.cheap_metrics(real, test, syn, DEFAULT)
    path = io.scratch_dir(spark, "metrics")
    io.write_metrics(m, path)
    back = spark.read.parquet(path).select("method", "vs", "metric", "value")
    return round_floats(back, 5)


@register("A6_save_load_fitted")
def q_a6(spark, sf_dir):
    """Precision and constraint parameters saved, reloaded, and applied to every
    synthetic method without refitting."""
    from cohortflow.operators import repair
    from cohortflow.plans.q_repair import FEATURES as _F

    real, _, syn = _tables(spark, sf_dir)
    r = real.select(*_F, "status", "time")
    tables = {"precision": repair.fit_precision(r, _F, 1000), "constraints": repair.resolve_constraints(r)}
    path = io.scratch_dir(spark, "fitted")
    io.save_fitted(tables, path)
    back = io.load_fitted(spark, path, ["precision", "constraints"])
    s = syn.select("method", "patient_id", *_F, "status", "time")
    s, _ = repair.match_precision(s, back["precision"], 1000, by=["method"])
    s, _ = repair.enforce_constraints(s, back["constraints"])
    return round_floats(s)


@register("C4_subsample_pair", with_ctes(*CLEAN_SYN, f"""
t AS (SELECT count(*) AS m FROM ctest)""", f"""
ranked AS (SELECT method, patient_id, row_number() OVER (PARTITION BY method ORDER BY {u_sql('patient_id', 42)}, patient_id) AS rn,
                  count(*) OVER (PARTITION BY method) AS n FROM csyn)""", f"""
slots AS (SELECT {u_sql('j', 'subsample:syn|42')} AS u FROM range(0, (SELECT 3 * m FROM t)) g(j))""", tail="""
SELECT 'real' AS side, 'real' AS method, patient_id FROM ctest
UNION ALL
SELECT 'syn', method, patient_id FROM ranked, t WHERE n >= 3 * m AND rn <= 3 * m
UNION ALL
SELECT 'syn', r.method, r.patient_id FROM slots, (SELECT DISTINCT method, n FROM ranked, t WHERE n < 3 * m) s
JOIN ranked r ON r.method = s.method AND r.rn = CAST(floor(u * s.n) AS BIGINT) + 1"""))
def q_c4(spark, sf_dir):
    """n rows of the real test split and 3 n of every method: without replacement
    where there are enough rows, with replacement where not."""
    _, test, syn = _tables(spark, sf_dir)
    n = test.count()
    a = sample.subsample(test, n, "patient_id", 42, side="real").select(
        F.lit("real").alias("side"), F.lit("real").alias("method"), "patient_id")
    b = sample.subsample(syn, 3 * n, "patient_id", 42, side="syn", by="method").select(
        F.lit("syn").alias("side"), "method", "patient_id")
    return a.unionByName(b)


# ------------------------------------------------------------------ k-NN ----

_KNN_COLS = FEATURES + ["time", "status"]


def _knn_sql():
    """Distances of all rows; a row keeps its five least ones, no pair is stored."""
    cols = _KNN_COLS
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in cols)

    def sc(c):
        return f"CASE WHEN hi_{c} - lo_{c} > 0 THEN (CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END AS {c}"

    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    return [f"mm AS (SELECT {mm} FROM ctrain)",
            f"rs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY patient_id) AS i, {', '.join(sc(c) for c in cols)} FROM ctrain, mm)",
            f"ss AS MATERIALIZED (SELECT method, row_number() OVER (ORDER BY method, patient_id) AS j, {', '.join(sc(c) for c in cols)} FROM csyn, mm)",
            f"""rrad AS MATERIALIZED (SELECT i, l[5] AS rad, l[1] AS nn1 FROM (
                SELECT a.i, min({d2}, 5) AS l FROM rs a JOIN rs b ON a.i <> b.i GROUP BY a.i))""",
            f"""srad AS MATERIALIZED (SELECT method, j, l[5] AS rad FROM (
                SELECT a.method, a.j, min({d2}, 5) AS l FROM ss a JOIN ss b ON a.method = b.method AND a.j <> b.j GROUP BY ALL))""",
            "rr AS MATERIALIZED (SELECT rs.*, rad, nn1 FROM rs JOIN rrad USING (i))",
            "sr AS MATERIALIZED (SELECT ss.*, rad FROM ss JOIN srad USING (method, j))",
            f"""of_syn AS (SELECT b.method, b.j, bool_or({d2} <= a.rad) AS hit FROM rr a JOIN sr b ON true GROUP BY ALL)""",
            f"""of_real AS (SELECT b.method, a.i, any_value(a.rad) AS rad, any_value(a.nn1) AS nn1, min({d2}) AS mind,
                   bool_or({d2} <= b.rad) AS rec, count_if({d2} <= a.rad) AS n_in FROM rr a JOIN sr b ON true GROUP BY ALL)""",
            ]


_KNN_TAIL = f"""
SELECT p.method, {sql_r6('p.precision')} AS precision, {sql_r6('q.recall')} AS recall, {sql_r6('q.n_in / (5.0 * p.m)')} AS density,
  {sql_r6('q.coverage')} AS coverage, {sql_r6('q.identifiability')} AS identifiability
FROM (SELECT method, count(*) AS m, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS precision FROM of_syn GROUP BY method) p
JOIN (SELECT method, avg(CASE WHEN rec THEN 1.0 ELSE 0.0 END) AS recall, sum(n_in) AS n_in, avg(CASE WHEN mind <= rad THEN 1.0 ELSE 0.0 END) AS coverage,
             avg(CASE WHEN mind < nn1 THEN 1.0 ELSE 0.0 END) AS identifiability FROM of_real GROUP BY method) q USING (method)"""


@register("F5_F13_prdc_identifiability", with_ctes(*CLEAN_SYN, *_knn_sql(), tail=_KNN_TAIL))
def q_f5(spark, sf_dir):
    """k-NN precision / recall / density / coverage (k = 5) and identifiability of
    all rows, min-max scaled by the real range."""
    from cohortflow.operators import neighbours

    real, _, syn = _tables(spark, sf_dir)
    return round_floats(neighbours.knn_metrics(real, syn, _KNN_COLS, k=5))


@register("F6_alpha_precision")
def q_f6(spark, sf_dir):
    """Naive alpha-precision / beta-coverage deltas and authenticity of all rows."""
    from cohortflow.operators import neighbours

    real, _, syn = _tables(spark, sf_dir)
    return round_floats(neighbours.alpha_precision(real, syn, _KNN_COLS))


@register("F13_identifiability", with_ctes(*CLEAN_SYN, *_knn_sql(), tail=f"""
SELECT method, identifiability FROM ({_KNN_TAIL})"""))
def q_f13(spark, sf_dir):
    """Share of real rows whose nearest synthetic row is nearer than their nearest other real row."""
    from cohortflow.operators import neighbours

    real, _, syn = _tables(spark, sf_dir)
    return round_floats(neighbours.identifiability(real, syn, _KNN_COLS))


_B23_TEXT = ["cancer_type", "subgroup", "sex", "ancestry", "msi_type"]
_B23_NUM = ["age", "purity", "mutation_count", "tmb", "fga", "ploidy"]


def _b23_sql():
    codes = " UNION ALL ".join(
        f"SELECT '{c}' AS col, value, row_number() OVER (ORDER BY value) - 1 AS code FROM "
        f"(SELECT DISTINCT {c} AS value FROM split WHERE is_train AND {c} IS NOT NULL)" for c in _B23_TEXT)
    coded = ", ".join(
        [f"CASE WHEN t.{c} IS NULL THEN -1.0 ELSE CAST((SELECT code FROM codes WHERE col = '{c}' AND value = t.{c}) AS DOUBLE) END AS {c}"
         for c in _B23_TEXT]
        + ["TRY_CAST(t.age AS DOUBLE) AS age", "TRY_CAST(t.purity AS DOUBLE) AS purity"]
        + [f"CAST(t.{c} AS DOUBLE) AS {c}" for c in ("mutation_count", "tmb", "fga", "ploidy")])
    cols = _B23_TEXT + _B23_NUM
    meds = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    fill = ", ".join(f"{sql_r6(f'coalesce({c}, m_{c}, 0.0)')} AS {c}" for c in cols)
    return with_ctes(*BASE_SPLIT, f"codes AS ({codes})",
                     f"coded AS (SELECT t.patient_id, {coded} FROM split t WHERE NOT t.is_train)",
                     f"med AS (SELECT {meds} FROM coded)", tail=f"SELECT patient_id, {fill} FROM coded, med")


from cohortflow.plans.oracle import BASE as BASE_SPLIT  # noqa: E402


@register("B23_median_then_zero_fill", _b23_sql())
def q_b23(spark, sf_dir):
    """Raw test split numericised: text via codes fitted on the train split
    (null -> -1, unseen -> missing), then this table's medians, then 0."""
    from cohortflow.operators import clean as _clean, repair
    from cohortflow.plans import cohort as _cohort

    s = _clean.to_numeric(_cohort.split_cohort(spark, sf_dir), ["age", "purity"])
    codes = encode.fit_categories(s.where("is_train"), _B23_TEXT)
    from pyspark.sql import Window

    codes = codes.withColumn("code", (F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)
                             .cast("int"))
    t = s.where(~F.col("is_train")).select("patient_id", *_B23_TEXT, *_B23_NUM)
    return round_floats(repair.median_then_zero_fill(t, codes, _B23_TEXT + _B23_NUM))
