"""DuckDB twin of the cleaning chain (``plans.pipeline``), stage by stage."""

from __future__ import annotations

from cohortflow.plans.oracle import BASE

CLEAN_CTES = [
    """dropped AS (SELECT * EXCLUDE (sample_id, sample_type) FROM split)""",
    """top AS (
  SELECT cancer_type AS value, count(*) AS train_count FROM dropped
  WHERE is_train AND cancer_type IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 15
)""",
    """bucketed AS (
  SELECT * REPLACE (CASE WHEN cancer_type IN (SELECT value FROM top) THEN cancer_type ELSE 'Other' END
                    AS cancer_type)
  FROM dropped
)""",
    """semantic_clipped AS (
  SELECT * REPLACE (CASE WHEN p < 0 THEN 0.0::DOUBLE WHEN p > 100 THEN 100.0::DOUBLE ELSE p END AS purity)
  FROM (SELECT *, TRY_CAST(purity AS DOUBLE) AS p FROM bucketed)
)""",
    """coerced AS (
  SELECT * EXCLUDE (p, sparse_note) REPLACE (TRY_CAST(age AS DOUBLE) AS age, NULLIF(msi_type, 'nan') AS msi_type)
  FROM semantic_clipped
)""",
    """medians AS (
  SELECT median(age) AS m_age, median(mutation_count) AS m_mut, median(purity) AS m_pur
  FROM coerced WHERE is_train
)""",
    """imputed AS (
  SELECT c.* REPLACE (coalesce(age, m_age) AS age, coalesce(mutation_count, m_mut) AS mutation_count,
                      coalesce(purity, m_pur) AS purity,
                      coalesce(ancestry, 'Unknown') AS ancestry, coalesce(msi_type, 'Unknown') AS msi_type)
  FROM coerced c, medians
)""",
    """p99 AS (
  SELECT quantile_cont(tmb, 0.99) AS hi_tmb, quantile_cont(mutation_count, 0.99) AS hi_mut
  FROM imputed WHERE is_train
)""",
    """quantile_clipped AS (
  SELECT i.* REPLACE (
    CASE WHEN tmb < 0 THEN 0.0::DOUBLE WHEN tmb > hi_tmb THEN hi_tmb ELSE tmb END AS tmb,
    CASE WHEN mutation_count < 0 THEN 0.0::DOUBLE WHEN mutation_count > hi_mut THEN hi_mut
         ELSE mutation_count END AS mutation_count)
  FROM imputed i, p99
)""",
    """restored AS (
  SELECT * REPLACE (CAST(round_even(age, 0) AS BIGINT) AS age,
                    CAST(round_even(mutation_count, 0) AS BIGINT) AS mutation_count)
  FROM quantile_clipped
)""",
    """codes AS (
  SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
  FROM (
    SELECT DISTINCT 'cancer_type' AS col, cancer_type AS value FROM restored WHERE is_train
    UNION ALL SELECT DISTINCT 'subgroup', subgroup FROM restored WHERE is_train
    UNION ALL SELECT DISTINCT 'sex', sex FROM restored WHERE is_train
    UNION ALL SELECT DISTINCT 'ancestry', ancestry FROM restored WHERE is_train
    UNION ALL SELECT DISTINCT 'msi_type', msi_type FROM restored WHERE is_train
  ) WHERE value IS NOT NULL
)""",
    """encoded AS (
  SELECT r.* REPLACE (
    CAST(coalesce(c1.code, 0) AS BIGINT) AS cancer_type, CAST(coalesce(c2.code, 0) AS BIGINT) AS subgroup,
    CAST(coalesce(c3.code, 0) AS BIGINT) AS sex, CAST(coalesce(c4.code, 0) AS BIGINT) AS ancestry,
    CAST(coalesce(c5.code, 0) AS BIGINT) AS msi_type)
  FROM restored r
  LEFT JOIN codes c1 ON c1.col = 'cancer_type' AND c1.value = r.cancer_type
  LEFT JOIN codes c2 ON c2.col = 'subgroup' AND c2.value = r.subgroup
  LEFT JOIN codes c3 ON c3.col = 'sex' AND c3.value = r.sex
  LEFT JOIN codes c4 ON c4.col = 'ancestry' AND c4.value = r.ancestry
  LEFT JOIN codes c5 ON c5.col = 'msi_type' AND c5.value = r.msi_type
)""",
    """ctrain AS (SELECT * EXCLUDE (is_train) FROM encoded WHERE is_train)""",
    """ctest AS (SELECT * EXCLUDE (is_train) FROM encoded WHERE NOT is_train)""",
]

CLEAN_BASE = BASE + CLEAN_CTES


def synth_sql(src: str, name: str) -> str:
    """The five derived synthetic methods drawn from ``src`` (DuckDB)."""
    return f"""{name} AS (
  SELECT *, 'copy' AS method FROM {src} WHERE h % 2 = 0
  UNION ALL BY NAME
  SELECT * REPLACE (time * 1.25 + 0.5 AS time, mutation_count + 3 AS mutation_count), 'shift' AS method FROM {src}
  UNION ALL BY NAME
  SELECT * REPLACE (time * 0.6 AS time), 'short' AS method FROM {src}
  UNION ALL BY NAME
  SELECT * REPLACE (mutation_count + 0.37 AS mutation_count,
                    CASE WHEN h % 10 = 0 THEN 1 - status ELSE status END AS status,
                    CASE WHEN h % 71 = 0 THEN 1.25::DOUBLE ELSE fga END AS fga), 'noisy' AS method FROM {src}
  UNION ALL BY NAME
  SELECT * REPLACE (12.0::DOUBLE AS time), 'collapsed' AS method FROM {src}
)"""


CLEAN_SYN = CLEAN_BASE + [synth_sql("ctrain", "csyn")]
