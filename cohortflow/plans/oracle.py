"""DuckDB SQL for the same derived cohort, used as the independent oracle.

The CTEs mirror ``plans.cohort`` step by step; each query's oracle is
``WITH <cohort ctes>, <query ctes> SELECT ...``.
"""

from __future__ import annotations

from cohortflow.sources.fixture import RAW_SQL

LABELLED = """
labelled AS (
  SELECT * EXCLUDE (os_months, os_status),
         CAST(starts_with(os_status, '1') AS INTEGER) AS status,
         CAST(os_months AS DOUBLE) AS time
  FROM raw
  WHERE os_months IS NOT NULL AND os_status IS NOT NULL
    AND os_months > 0 AND os_months < 600
)"""

PATIENTS = """
patients AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_id
              ORDER BY CASE WHEN sample_type = 'Primary' THEN 0 ELSE 1 END, sample_id) AS rn
    FROM labelled) WHERE rn = 1
)"""

SPLIT = """
split AS (
  SELECT *, ((('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|42'), 1, 8))::BIGINT + 0.5::DOUBLE)
             / 4294967296.0::DOUBLE) < 0.8::DOUBLE AS is_train
  FROM patients
),
train AS (SELECT * EXCLUDE (is_train) FROM split WHERE is_train),
test AS (SELECT * EXCLUDE (is_train) FROM split WHERE NOT is_train)"""

SYNTH = """
syn AS (
  SELECT *, 'copy' AS method FROM train WHERE h % 2 = 0
  UNION ALL BY NAME
  SELECT * REPLACE (time * 1.25 + 0.5 AS time, mutation_count + 3 AS mutation_count), 'shift' AS method FROM train
  UNION ALL BY NAME
  SELECT * REPLACE (time * 0.6 AS time), 'short' AS method FROM train
  UNION ALL BY NAME
  SELECT * REPLACE (mutation_count + 0.37 AS mutation_count,
                    CASE WHEN h % 10 = 0 THEN 1 - status ELSE status END AS status,
                    CASE WHEN h % 71 = 0 THEN 1.25::DOUBLE ELSE fga END AS fga), 'noisy' AS method FROM train
  UNION ALL BY NAME
  SELECT * REPLACE (12.0::DOUBLE AS time), 'collapsed' AS method FROM train
)"""


def with_ctes(*parts: str, tail: str) -> str:
    """Join CTE bodies into one ``WITH`` statement followed by ``tail``."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + tail


BASE = [RAW_SQL, LABELLED, PATIENTS, SPLIT]
BASE_SYN = BASE + [SYNTH]


def km_sql(name: str, src: str, keys: list[str]) -> str:
    """Kaplan-Meier CTEs in DuckDB: plain windows and a running product."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k} " if keys else ""
    sel = f"{k}, " if keys else ""
    return f"""
{name}_ev AS (
  SELECT {sel}time, CAST(sum(status) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS c
  FROM {src} GROUP BY ALL
),
{name}_n AS (
  SELECT *, sum(c) OVER ({part}ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM {name}_ev
),
{name} AS (
  SELECT *, product(1 - d / n) OVER ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM {name}_n
)"""


def gap_sql(real_src: str, syn_src: str, by: list[str], syn_keys: list[str], n_grid: int = 500) -> str:
    """Survival-gap CTEs (E4) ending in ``gap``: grid by generate_series, ASOF joins."""
    keys = syn_keys + by
    kk = ", ".join(keys)
    bb = ", ".join(by)
    on_by = " AND ".join([f"t.{c} = r.{c}" for c in by])
    on_keys = " AND ".join([f"g.{c} = s.{c}" for c in keys])
    on_by_g = " AND ".join([f"g.{c} = r.{c}" for c in by])
    m = n_grid - 1
    return km_sql("km_r", real_src, by) + "," + km_sql("km_s", syn_src, keys) + f""",
t_r AS (SELECT {bb}, max(time) AS T_real FROM {real_src} GROUP BY ALL),
t_s AS (SELECT {kk}, max(time) AS T_syn FROM {syn_src} GROUP BY ALL),
tt AS (SELECT t.*, r.T_real, greatest(r.T_real, t.T_syn) AS T FROM t_s t JOIN t_r r ON {on_by}),
grid AS (
  SELECT {kk}, T, i, CASE WHEN i = {m} THEN T ELSE CAST(i AS DOUBLE) * (T / {m}.0::DOUBLE) END AS x
  FROM tt, range(0, {n_grid}) AS rg(i) WHERE T > 0
),
g_r AS (
  SELECT g.*, coalesce(r.s, 1.0::DOUBLE) AS s_real
  FROM grid g ASOF LEFT JOIN km_r r ON {on_by_g} AND g.x >= r.time
),
g_rs AS (
  SELECT g.*, coalesce(s.s, 1.0::DOUBLE) AS s_syn
  FROM g_r g ASOF LEFT JOIN km_s s ON {on_keys} AND g.x >= s.time
),
seg AS (
  SELECT {kk}, T,
    (lead(x) OVER w - x) * ((s_syn - s_real) + lead(s_syn - s_real) OVER w) / 2.0 AS o,
    (lead(x) OVER w - x) * (abs(s_syn - s_real) + lead(abs(s_syn - s_real)) OVER w) / 2.0 AS kd
  FROM g_rs WINDOW w AS (PARTITION BY {kk} ORDER BY i)
),
integ AS (SELECT {kk}, sum(o) / any_value(T) AS optimism, sum(kd) / any_value(T) AS km_divergence
          FROM seg GROUP BY ALL),
gap AS (
  SELECT tt.{kk.replace(', ', ', tt.')}, integ.optimism, integ.km_divergence,
         CASE WHEN T_real > 0 THEN greatest(0.0::DOUBLE, (T_real - T_syn) / T_real) ELSE 0.0::DOUBLE END
           AS short_sightedness
  FROM tt LEFT JOIN integ USING ({kk})
)"""
