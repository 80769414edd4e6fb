"""Queries for survival statistics, fidelity, privacy and comparison
(C3-C8, D1, D9, E1-E6, E14, F1-F4, F7, F11-F12, F15-F20, F24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions.exprs import round_floats, sql_r6
from cohortflow.operators import compare, fidelity, privacy, survival
from cohortflow.plans import pipeline
from cohortflow.plans.oracle import gap_sql, km_sql, with_ctes
from cohortflow.plans.oracle_clean import CLEAN_SYN
from cohortflow.plans.q_repair import FEATURES, NORM_SQL, clean_syn
from cohortflow.plans.registry import register
from cohortflow.schema import DEFAULT

COLS = FEATURES + ["time", "status"]


def _tables(spark, sf_dir):
    res = pipeline.clean_cohort(spark, sf_dir)
    real, syn = clean_syn(spark, sf_dir)
    return real, res.test, syn


def stack_sql(src: str, cols, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL" for c in cols)


# ------------------------------------------------------------------ E1-E5 ----

@register("E1_kaplan_meier", with_ctes(*CLEAN_SYN, km_sql("km", "ctrain", ["subgroup"]).strip(), tail=f"""
SELECT subgroup, {sql_r6('time')} AS time, CAST(n AS BIGINT) AS n_at_risk, CAST(d AS BIGINT) AS d,
       CAST(c AS BIGINT) AS c, {sql_r6('s')} AS s FROM km"""))
def q_e1(spark, sf_dir):
    real, _, _ = _tables(spark, sf_dir)
    return round_floats(survival.kaplan_meier(real, DEFAULT, ["subgroup"]))


@register("E2_km_confidence", with_ctes(*CLEAN_SYN, km_sql("km", "ctest", []).strip(), """
kg AS (SELECT *, sum(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0 END)
         OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM km)""", tail=f"""
SELECT {sql_r6('time')} AS time, CAST(n AS BIGINT) AS n_at_risk, CAST(d AS BIGINT) AS d, CAST(c AS BIGINT) AS c,
  {sql_r6('s')} AS s,
  {sql_r6('CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054 * sqrt(g) / ln(s))) END')} AS lower,
  {sql_r6('CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054 * sqrt(g) / ln(s))) END')} AS upper
FROM kg"""))
def q_e2(spark, sf_dir):
    _, test, _ = _tables(spark, sf_dir)
    return round_floats(survival.km_confidence(test, DEFAULT))


@register("E3_step_at", with_ctes(*CLEAN_SYN, km_sql("km", "ctest", []).strip(), """
tt AS (SELECT max(time) AS T FROM ctest)""", """
grid AS (SELECT i, CASE WHEN i = 499 THEN T ELSE CAST(i AS DOUBLE) * (T / 499.0::DOUBLE) END AS x FROM tt, range(0, 500) r(i))""",
    tail=f"""
SELECT i, {sql_r6('x')} AS g, {sql_r6('coalesce(k.s, 1.0::DOUBLE)')} AS s
FROM grid ASOF LEFT JOIN km k ON grid.x >= k.time"""))
def q_e3(spark, sf_dir):
    _, test, _ = _tables(spark, sf_dir)
    t = test.withColumn("_all", survival.whole_table_key("time"))
    km = survival.kaplan_meier(t, DEFAULT, ["_all"])
    grid = t.groupBy("_all").agg(F.max("time").alias("T"))
    out = survival.step_at(km, grid, ["_all"], "time", 500)
    return round_floats(out.select("i", "g", "s"))


@register("E4_survival_gap", with_ctes(*CLEAN_SYN, NORM_SQL, """
rt AS (SELECT 0 AS g, time, status FROM ctest)""", """
st AS (SELECT method, 0 AS g, time, status FROM csyn_n)""", gap_sql("rt", "st", ["g"], ["method"]).strip(), tail=f"""
SELECT method, {sql_r6('optimism')} AS optimism, {sql_r6('km_divergence')} AS km_divergence,
       {sql_r6('short_sightedness')} AS short_sightedness FROM gap"""))
def q_e4(spark, sf_dir):
    from cohortflow.operators import clean
    _, test, syn = _tables(spark, sf_dir)
    syn = clean.normalise_labels(syn, DEFAULT)
    return round_floats(survival.survival_gap(test, syn, DEFAULT, by=[], syn_keys=["method"]))


@register("E5_event_rates", with_ctes(*CLEAN_SYN, NORM_SQL, tail=f"""
SELECT method, {sql_r6('r')} AS real_event_rate, {sql_r6('s')} AS syn_event_rate,
       {sql_r6('abs(r - s)')} AS censoring_rate_diff
FROM (SELECT method, avg(CAST(status AS DOUBLE)) AS s FROM csyn_n GROUP BY method),
     (SELECT avg(CAST(status AS DOUBLE)) AS r FROM ctest)"""))
def q_e5(spark, sf_dir):
    from cohortflow.operators import clean
    _, test, syn = _tables(spark, sf_dir)
    syn = clean.normalise_labels(syn, DEFAULT)
    return round_floats(survival.event_rate_gap(test, syn, DEFAULT, by=[], syn_keys=["method"]))


_SCORES = FEATURES


def _conc_sql(src):
    parts = []
    for sc in _SCORES:
        parts.append(f"""
SELECT '{sc}' AS score_name,
  sum(CASE WHEN b.{sc} > a.{sc} THEN 1.0 WHEN b.{sc} = a.{sc} THEN 0.5 ELSE 0.0 END) AS num,
  count(*) AS comp
FROM {src} a JOIN {src} b
  ON a.status = 1 AND (b.time > a.time OR (b.time = a.time AND b.status = 0))""")
    return " UNION ALL ".join(parts)


@register("E6_concordance", with_ctes(*CLEAN_SYN, tail=f"""
SELECT score_name, CAST(comp AS BIGINT) AS n_comparable, {sql_r6('num / comp')} AS c_index
FROM ({_conc_sql('ctest')})"""))
def q_e6(spark, sf_dir):
    """Harrell's C of every covariate on the real test split (brute-force pairs in the oracle)."""
    _, test, _ = _tables(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("score")) for s in _SCORES])
    long = test.select("time", "status", F.explode(arr).alias("x")).select("time", "status", "x.*")
    return round_floats(survival.concordance(long, DEFAULT, "score", by=["score_name"]))


@register("E14_retrofit_bounds", with_ctes(*CLEAN_SYN, tail=f"""
SELECT {sql_r6('t_min')} AS t_min, {sql_r6('t_max')} AS t_max, {sql_r6('l_min')} AS log_t_min,
       {sql_r6('l_max')} AS log_t_max,
       {sql_r6('l_min - 0.05 * greatest(l_max - l_min, 1e-6)')} AS log_clamp_lo,
       {sql_r6('l_max + 0.05 * greatest(l_max - l_min, 1e-6)')} AS log_clamp_hi,
       {sql_r6('0.5 * t_min')} AS t_clamp_lo, {sql_r6('2.0 * t_max')} AS t_clamp_hi
FROM (SELECT min(time) AS t_min, max(time) AS t_max, min(ln(greatest(time, 0.001))) AS l_min,
             max(ln(greatest(time, 0.001))) AS l_max FROM ctrain)"""))
def q_e14(spark, sf_dir):
    from cohortflow.operators import models
    real, _, _ = _tables(spark, sf_dir)
    return round_floats(models.retrofit_bounds(real, DEFAULT, margin=0.05))


# ------------------------------------------------------------------ F1-F7 ----

def _bins_sql(nb=10):
    return f"""
rs AS ({stack_sql('ctrain', COLS)}),
ss AS ({stack_sql('csyn', COLS, 'method')}),
bins AS (SELECT "column", count(DISTINCT value) <= 20 AS discrete, min(value) AS lo, max(value) AS hi
         FROM rs GROUP BY "column"),
rb AS (SELECT "column", CASE WHEN discrete THEN value ELSE CAST(CASE WHEN hi - lo <= 0 THEN 0
         ELSE least(greatest(floor((value - lo) / (hi - lo) * {nb}), 0), {nb - 1}) END AS DOUBLE) END AS bin
       FROM rs JOIN bins USING ("column")),
sb AS (SELECT method, "column", CASE WHEN discrete THEN value ELSE CAST(CASE WHEN hi - lo <= 0 THEN 0
         ELSE least(greatest(floor((value - lo) / (hi - lo) * {nb}), 0), {nb - 1}) END AS DOUBLE) END AS bin
       FROM ss JOIN bins USING ("column")),
rc AS (SELECT "column", bin, count(*) AS n FROM rb GROUP BY ALL),
sc AS (SELECT method, "column", bin, count(*) AS n FROM sb GROUP BY ALL),
ks AS (SELECT DISTINCT method, "column" FROM sc),
rk AS (SELECT ks.method, rc.* FROM rc JOIN ks USING ("column")),
fj AS (SELECT coalesce(rk.method, sc.method) AS method, coalesce(rk."column", sc."column") AS "column",
              coalesce(rk.n, 0) AS cr, coalesce(sc.n, 0) AS cs
       FROM rk FULL OUTER JOIN sc ON rk.method = sc.method AND rk."column" = sc."column" AND rk.bin = sc.bin),
fr AS (SELECT *, sum(cr) OVER (PARTITION BY method, "column") AS nr, sum(cs) OVER (PARTITION BY method, "column") AS ns,
              count(*) OVER (PARTITION BY method, "column") AS k FROM fj)"""


@register("F1_jensen_shannon", with_ctes(*CLEAN_SYN, _bins_sql().strip(), tail=f"""
SELECT method, "column", {sql_r6('sqrt(greatest(sum((CASE WHEN cr > 0 THEN (cr / nr) * ln((cr / nr) / ((cr / nr + cs / ns) / 2)) ELSE 0 END + CASE WHEN cs > 0 THEN (cs / ns) * ln((cs / ns) / ((cr / nr + cs / ns) / 2)) ELSE 0 END) / 2.0), 0.0))')} AS js_distance
FROM fr GROUP BY method, "column\""""))
def q_f1(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.jensen_shannon(real, syn, COLS, by=["method"]))


@register("F7_inverse_kl", with_ctes(*CLEAN_SYN, _bins_sql().strip(), tail=f"""
SELECT method, "column", {sql_r6('1.0 / (1.0 + sum(((cr + 1.0) / (nr + k)) * ln(((cr + 1.0) / (nr + k)) / ((cs + 1.0) / (ns + k)))))')} AS inv_kl
FROM fr GROUP BY method, "column\""""))
def q_f7(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.inverse_kl(real, syn, COLS, by=["method"]))


def _w1_sql(r_src, s_src, gkey):
    """W1 in DuckDB by brute force over the union of distinct values."""
    return f"""
rv AS (SELECT {gkey}, value, count(*) AS nr FROM {r_src} GROUP BY ALL),
sv AS (SELECT method, {gkey}, value, count(*) AS ns FROM {s_src} GROUP BY ALL),
pk AS (SELECT DISTINCT method, {gkey} FROM sv),
rvk AS (SELECT pk.method, rv.* FROM rv JOIN pk USING ({gkey})),
u AS (SELECT coalesce(rvk.method, sv.method) AS method, coalesce(rvk.{gkey}, sv.{gkey}) AS {gkey},
             coalesce(rvk.value, sv.value) AS value, coalesce(nr, 0) AS nr, coalesce(ns, 0) AS ns
      FROM rvk FULL OUTER JOIN sv ON rvk.method = sv.method AND rvk.{gkey} = sv.{gkey} AND rvk.value = sv.value),
cu AS (SELECT *, sum(nr) OVER w AS cr, sum(ns) OVER w AS cs, lead(value) OVER w2 AS nxt,
              sum(nr) OVER (PARTITION BY method, {gkey}) AS tot_r, sum(ns) OVER (PARTITION BY method, {gkey}) AS tot_s
       FROM u WINDOW w AS (PARTITION BY method, {gkey} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     w2 AS (PARTITION BY method, {gkey} ORDER BY value)),
w1 AS (SELECT method, {gkey}, CASE WHEN any_value(tot_r) > 0 AND any_value(tot_s) > 0
              THEN coalesce(sum(abs(cr / tot_r - cs / tot_s) * (nxt - value)), 0.0) END AS w1
       FROM cu GROUP BY ALL)"""


@register("F2_wasserstein_time", with_ctes(*CLEAN_SYN, """
rt AS (SELECT CASE WHEN status = 1 THEN 'event' ELSE 'censor' END AS subset, CAST(time AS DOUBLE) AS value FROM ctrain)""",
    """st AS (SELECT method, CASE WHEN status = 1 THEN 'event' ELSE 'censor' END AS subset, CAST(time AS DOUBLE) AS value FROM csyn)""",
    _w1_sql("rt", "st", "subset").strip(), tail=f"SELECT method, subset, {sql_r6('w1')} AS w1 FROM w1"))
def q_f2(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.wasserstein_time(real, syn, DEFAULT, by=["method"]))


_MM = f"""
mm AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM ({stack_sql('ctrain', COLS)}) GROUP BY "column"),
rsc AS (SELECT "column", CASE WHEN hi - lo > 0 THEN (value - lo) / (hi - lo) ELSE 0.0 END AS value
        FROM ({stack_sql('ctrain', COLS)}) JOIN mm USING ("column")),
ssc AS (SELECT method, "column", CASE WHEN hi - lo > 0 THEN (value - lo) / (hi - lo) ELSE 0.0 END AS value
        FROM ({stack_sql('csyn', COLS, 'method')}) JOIN mm USING ("column"))"""


@register("F3_wasserstein_columns", with_ctes(*CLEAN_SYN, _MM.strip(), _w1_sql("rsc", "ssc", '"column"').strip(),
                                              tail=f'SELECT method, "column", {sql_r6("w1")} AS w1 FROM w1'))
def q_f3(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.wasserstein_columns(real, syn, COLS, by=["method"]))


def _sliced_sql():
    """Projections of min-max scaled rows on the seeded directions, as literals."""
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in COLS)
    scaled = [f"coalesce(CASE WHEN hi_{c} > lo_{c} THEN (CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) END, 0.0::DOUBLE)" for c in COLS]
    project = ", ".join("0.0::DOUBLE + " + " + ".join(f"{x} * {w!r}::DOUBLE" for x, w in zip(scaled, d)) for d in fidelity.directions(len(COLS)))
    return [f"mm AS (SELECT {mm} FROM ctrain)",
            *[f"""{name} AS (SELECT {key} CAST(d - 1 AS INTEGER) AS direction, p[d] AS value
                FROM (SELECT {key} [{project}] AS p FROM {src}, mm), range(1, 17) r(d))""" for name, src, key in (("rsl", "ctrain", ""), ("ssl", "csyn", "method,"))],
            _w1_sql("rsl", "ssl", "direction").strip()]


@register("F3_wasserstein_sliced", with_ctes(*CLEAN_SYN, *_sliced_sql(), tail=f"SELECT method, direction, {sql_r6('w1')} AS w1 FROM w1"))
def q_f3_sliced(spark, sf_dir):
    """Joint distance: W1 of all rows on 16 seeded directions."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.wasserstein_sliced(real, syn, COLS, by=["method"]))


@register("F4_mmd_linear", with_ctes(*CLEAN_SYN, _MM.strip(), tail=f"""
SELECT s.method, {sql_r6('sum(pow(s.m - r.m, 2))')} AS mmd_linear
FROM (SELECT method, "column", avg(value) AS m FROM ssc GROUP BY ALL) s
JOIN (SELECT "column", avg(value) AS m FROM rsc GROUP BY ALL) r USING ("column") GROUP BY s.method"""))
def q_f4(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.mmd_linear(real, syn, COLS, by=["method"]))


# ------------------------------------------------------------------ F11-F12 --

QUASI = ["age", "sex", "ancestry"]


@register("F11_k_anonymity", with_ctes(*CLEAN_SYN, tail="""
SELECT method, min(n)::BIGINT AS k_anonymity, count(*)::BIGINT AS n_classes FROM (
  SELECT 'real' AS method, age, sex, ancestry, count(*) AS n FROM ctrain GROUP BY ALL
  UNION ALL SELECT method, age, sex, ancestry, count(*) FROM csyn GROUP BY ALL) GROUP BY method"""))
def q_f11(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    both = real.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
    return privacy.k_anonymity(both, QUASI, by=["method"])


@register("F12_l_diversity", with_ctes(*CLEAN_SYN, tail="""
SELECT method, min(l)::BIGINT AS l_diversity FROM (
  SELECT 'real' AS method, count(DISTINCT cancer_type) AS l FROM ctrain GROUP BY age, sex, ancestry
  UNION ALL SELECT method, count(DISTINCT cancer_type) FROM csyn GROUP BY method, age, sex, ancestry) GROUP BY method"""))
def q_f12(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    both = real.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
    return privacy.l_diversity(both, QUASI, "cancer_type", by=["method"])


@register("F11_F12_cluster_privacy")
def q_f11_clusters(spark, sf_dir):
    """Smallest cluster and least number of cancer types of a cluster, k-means with 2, 5, 10 and 15 clusters."""
    real, _, syn = _tables(spark, sf_dir)
    both = real.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
    return privacy.cluster_privacy(both, COLS, "cancer_type")


# ------------------------------------------------------------------ F16-F20 --

@register("F16_preflight", with_ctes(*CLEAN_SYN, """
rr AS (SELECT min(time) AS r_lo, max(time) AS r_hi, avg(CAST(status AS DOUBLE)) AS r_ev FROM ctrain)""", """
st AS (SELECT method, count(*) AS n, count_if(time IS NULL) AS na_t, count_if(status IS NULL) AS na_s, count(time) AS n_t,
         count_if(time < r_lo * 0.5) AS n_below, count_if(time > r_hi * 2.0) AS n_above,
         quantile_cont(time, 0.05) AS q05, quantile_cont(time, 0.95) AS q95,
         count_if(status IS NOT NULL AND round_even(CAST(status AS DOUBLE), 0) NOT IN (0.0, 1.0)) AS n_nonbinary,
         avg(least(greatest(round_even(CAST(status AS DOUBLE), 0), 0.0), 1.0)) AS s_ev,
         any_value(r_lo) AS r_lo, any_value(r_hi) AS r_hi, any_value(r_ev) AS r_ev
       FROM csyn, rr GROUP BY method)""", """
ck AS (
  SELECT method, 'null_time' AS "check", CASE WHEN na_t > 0.01 * n THEN 'warn' ELSE 'ok' END AS severity FROM st
  UNION ALL SELECT method, 'null_status', CASE WHEN na_s > 0.01 * n THEN 'warn' ELSE 'ok' END FROM st
  UNION ALL SELECT method, 'time_range', CASE WHEN n_below + n_above > 0.1 * n_t THEN 'fail'
                                              WHEN n_below + n_above > 0 THEN 'warn' ELSE 'ok' END FROM st
  UNION ALL SELECT method, 'time_collapsed', CASE WHEN q95 - q05 < 0.05 * (r_hi - r_lo) THEN 'fail' ELSE 'ok' END FROM st
  UNION ALL SELECT method, 'status_binary', CASE WHEN n_nonbinary > 0 THEN 'warn' ELSE 'ok' END FROM st
  UNION ALL SELECT method, 'event_rate', CASE WHEN abs(s_ev - r_ev) > 0.15 THEN 'warn' ELSE 'ok' END FROM st
)""", tail="""
SELECT method, "check", severity, max(CASE WHEN severity = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY method) = 0 AS passed
FROM ck"""))
def q_f16(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return compare.preflight(syn, real, DEFAULT).select("method", "check", "severity", "passed")


@register("F18_marginal_table", with_ctes(*CLEAN_SYN, f"""
rs AS ({stack_sql('ctrain', COLS)})""", f"""
ss AS ({stack_sql('csyn', COLS, 'method')})""", """
disc AS (SELECT "column", count(DISTINCT value) <= 20 AS discrete FROM rs GROUP BY "column")""", """
pairs AS (SELECT DISTINCT method, "column" FROM ss)""", """
rsk AS (SELECT p.method, rs."column", rs.value, d.discrete FROM rs JOIN pairs p USING ("column") JOIN disc d USING ("column"))""", """
ssk AS (SELECT ss.method, ss."column", ss.value, d.discrete FROM ss JOIN disc d USING ("column"))""", """
rng AS (SELECT method, "column", quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
        FROM (SELECT * FROM rsk UNION ALL SELECT * FROM ssk) WHERE NOT discrete GROUP BY ALL)""", """
dr AS (SELECT method, "column", 'value' AS kind, value AS x, count(*) / sum(count(*)) OVER (PARTITION BY method, "column") AS share
       FROM rsk WHERE discrete GROUP BY method, "column", value)""", """
ds AS (SELECT method, "column", 'value' AS kind, value AS x, count(*) / sum(count(*)) OVER (PARTITION BY method, "column") AS share
       FROM ssk WHERE discrete GROUP BY method, "column", value)""", """
cr AS (SELECT k.method, k."column", 'bin' AS kind,
         CAST(CASE WHEN value = hi THEN 28 ELSE floor((value - lo) / ((hi - lo) / 29)) END AS DOUBLE) AS x,
         count(*) AS n, any_value((hi - lo) / 29) AS w
       FROM rsk k JOIN rng USING (method, "column")
       WHERE value >= lo AND value <= hi AND hi > lo GROUP BY ALL)""", """
cs AS (SELECT k.method, k."column", 'bin' AS kind,
         CAST(CASE WHEN value = hi THEN 28 ELSE floor((value - lo) / ((hi - lo) / 29)) END AS DOUBLE) AS x,
         count(*) AS n, any_value((hi - lo) / 29) AS w
       FROM ssk k JOIN rng USING (method, "column")
       WHERE value >= lo AND value <= hi AND hi > lo GROUP BY ALL)""", """
r_all AS (SELECT method, "column", kind, x, share AS real FROM dr
          UNION ALL SELECT method, "column", kind, x, n / (sum(n) OVER (PARTITION BY method, "column") * w) FROM cr)""", """
s_all AS (SELECT method, "column", kind, x, share AS syn FROM ds
          UNION ALL SELECT method, "column", kind, x, n / (sum(n) OVER (PARTITION BY method, "column") * w) FROM cs)""",
    tail=f"""
SELECT coalesce(r.method, s.method) AS method, coalesce(r."column", s."column") AS "column",
       coalesce(r.kind, s.kind) AS kind, {sql_r6('coalesce(r.x, s.x)')} AS x,
       {sql_r6('coalesce(real, 0.0)')} AS real, {sql_r6('coalesce(syn, 0.0)')} AS syn
FROM r_all r FULL OUTER JOIN s_all s ON r.method = s.method AND r."column" = s."column" AND r.kind = s.kind AND r.x = s.x"""))
def q_f18(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.marginal_table(real, syn, COLS, by=["method"]))


def _hist_sql(src, key):
    return f"""
SELECT k AS method, CAST(bin AS INTEGER) AS bin, {sql_r6('bin * ((any_value(hi) - any_value(lo)) / 15.0) + any_value(lo)')} AS left_edge,
       count(*)::BIGINT AS n FROM (
  SELECT *, CASE WHEN hi = lo THEN 0 ELSE
    (CASE WHEN i1 < 14 AND t >= (CASE WHEN i1 + 1 = 15 THEN hi ELSE CAST(i1 + 1 AS DOUBLE) * ((hi - lo) / 15.0) + lo END)
          THEN i1 + 1 ELSE i1 END) END AS bin
  FROM (
    SELECT *, CASE WHEN i0 > 0 AND t < (CASE WHEN i0 = 15 THEN hi ELSE CAST(i0 AS DOUBLE) * ((hi - lo) / 15.0) + lo END)
                   THEN i0 - 1 ELSE i0 END AS i1
    FROM (
      SELECT *, CAST(least(greatest(floor((t - lo) * (15.0 / (hi - lo))), 0), 14) AS INTEGER) AS i0
      FROM (SELECT {key} AS k, CAST(time AS DOUBLE) AS t FROM {src}) x
      JOIN (SELECT {key} AS k, min(CAST(time AS DOUBLE)) AS lo, max(CAST(time AS DOUBLE)) AS hi FROM {src} GROUP BY 1) y USING (k))))
GROUP BY k, bin"""


@register("F19_time_histogram", with_ctes(*CLEAN_SYN, tail=_hist_sql("ctrain", "'real'") + " UNION ALL " + _hist_sql("csyn", "method")))
def q_f19(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    both = real.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
    h = fidelity.time_histogram(both, DEFAULT, by=["method"], bins=15)
    return round_floats(h.withColumn("bin", F.col("bin").cast("int")))


_SP_COLS = COLS


def _spearman_sql():
    ranks = ", ".join(f"""(rank() OVER (PARTITION BY method ORDER BY {c}) - 1)
              + (count(*) OVER (PARTITION BY method, {c}) + 1) / 2.0 AS {c}""" for c in _SP_COLS)
    pairs = [(a, b) for i, a in enumerate(_SP_COLS) for b in _SP_COLS[i + 1:]]
    cells = ", ".join(f"CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN corr({a}, {b}) END AS p{k}"
                      for k, (a, b) in enumerate(pairs))
    return with_ctes(*CLEAN_SYN, """allt AS (SELECT 'real' AS method, * FROM ctrain UNION ALL BY NAME SELECT * FROM csyn)""",
                     f"rk AS (SELECT method, {ranks} FROM allt)", f"co AS (SELECT method, {cells} FROM rk GROUP BY method)",
                     tail=" UNION ALL ".join(f"SELECT method, '{a}' AS c1, '{b}' AS c2, {sql_r6(f'p{k}')} AS rho FROM co"
                                             for k, (a, b) in enumerate(pairs)))


@register("F20_spearman_panel", _spearman_sql())
def q_f20(spark, sf_dir):
    real, _, syn = _tables(spark, sf_dir)
    both = real.withColumn("method", F.lit("real")).unionByName(syn, allowMissingColumns=True)
    return round_floats(fidelity.spearman_panel(both, _SP_COLS, "patient_id", by=["method"]))


def _mmd_rbf_sql(n_features=128, sigma=0.5, seed=0):
    W, b = fidelity.rff_params(len(COLS), n_features, sigma, seed)
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in COLS)

    def x(c):
        return f"((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}))"

    def feat(k):
        z = f"{W[k][0]!r} * {x(COLS[0])}"
        for j in range(1, len(COLS)):
            z = f"({z} + {W[k][j]!r} * {x(COLS[j])})"
        return f"avg(cos({z} + {b[k]!r})) AS f{k}"

    feats = ", ".join(feat(k) for k in range(n_features))
    r_long = " UNION ALL ".join(f"SELECT {k} AS k, f{k} AS mr FROM rf" for k in range(n_features))
    s_long = " UNION ALL ".join(f"SELECT method, {k} AS k, f{k} AS ms FROM sf" for k in range(n_features))
    return with_ctes(*CLEAN_SYN, f"mm AS (SELECT {mm} FROM ctrain)",
                     f"rf AS (SELECT {feats} FROM ctrain, mm)",
                     f"sf AS (SELECT method, {feats} FROM csyn, mm GROUP BY method)",
                     f"rl AS ({r_long})", f"sl AS ({s_long})", tail=f"""
SELECT method, {sql_r6(f'sum((ms - mr) * (ms - mr)) * {2.0 / n_features!r}')} AS mmd_rbf
FROM sl JOIN rl USING (k) GROUP BY method""")


@register("F4_mmd_rbf", _mmd_rbf_sql())
def q_f4_rbf(spark, sf_dir):
    """RBF-kernel MMD by 128 random Fourier features (seeded), real train vs each method."""
    real, _, syn = _tables(spark, sf_dir)
    return round_floats(fidelity.mmd_rbf(real, syn, COLS, by=["method"]))
