"""Sample-level survival cohort derived from the driver's TPC-H-like tables.

One row = one sample: ``lineitem ⨝ orders ⨝ customer ⨝ part``. The same
expressions exist in DuckDB SQL (``RAW_SQL``) so every operator built on the
cohort can be checked against an independent engine. Faults (nulls, -1
sentinels, text tokens, outliers) are injected from a per-row md5 hash ``h``
so both engines inject them on the same rows.

Joins: customer meets the narrow orders first, so that the samples are shuffled
for lineitem ⨝ orders (large-large, sort-merge on the order key) and for part
only. Customer and part are dimensions whose size grows with the scale factor,
so no broadcast is forced -- AQE broadcasts them at run time when their measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle
join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.hashing import hash32


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(h: Column, m: int) -> Column:
    return (h % m) == 0


def sample_id() -> Column:
    """The row id of a sample, of lineitem's columns."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       cents.cast("string"))


def sample_type() -> Column:
    return (F.when(F.col("l_returnflag") == "A", "Primary")
             .when(F.col("l_returnflag") == "R", "Metastasis")
             .otherwise("Unknown"))


def raw_labels() -> list[Column]:
    """``os_months`` and ``os_status``, of ``ordered_samples``' columns."""
    h = F.col("h")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return [F.when(_at(h, 53), F.lit(None).cast("double"))
             .otherwise(days / F.lit(30.4375)).alias("os_months"),
            F.when(_at(h, 59), F.lit(None).cast("string"))
             .when(F.col("o_orderstatus") == "F", F.lit("1:DECEASED"))
             .otherwise(F.lit("0:LIVING")).alias("os_status")]


def ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⨝ orders ⨝ customer with the hash ``h``: samples before part meets them."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate")
    od = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cu = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # the hash depends on lineitem only: computing it before the joins keeps md5 to
    # one evaluation per row (filters pushed into the join condition then reference
    # the column instead of re-deriving it); the row id it is made of is written
    # after the joins, so that no shuffle carries it
    li = li.withColumn("h", hash32(sample_id()))
    return li.join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey)


def raw_samples(spark: SparkSession, sf_dir: str, ordered: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """The raw sample table (FIXTURES.md §2), faults included; of ``ordered`` where
    given, rows of ``ordered_samples``. A ``how`` of left also keeps samples without
    their part, told by ``no_part``, and the column ``tied`` of ``ordered``."""
    j = ordered_samples(spark, sf_dir) if ordered is None else ordered
    pa = _read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    j = j.join(pa, j.l_partkey == pa.p_partkey, how)
    h = F.col("h")
    months, status = raw_labels()
    age_txt = F.when(F.col("p_size") > 47, F.lit(">47")).otherwise(F.col("p_size").cast("string"))
    return j.select(
        sample_id().alias("sample_id"),
        F.col("l_orderkey").alias("patient_id"),
        sample_type().alias("sample_type"),
        months,
        status,
        F.when(_at(h, 61), F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("cancer_type"),
        F.col("p_type").alias("subgroup"),
        F.when(_at(h, 43), F.lit(None).cast("string")).otherwise(age_txt).alias("age"),
        F.col("l_linestatus").alias("sex"),
        F.when(_at(h, 11), F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("ancestry"),
        F.when(_at(h, 29), F.lit("nan")).otherwise(F.col("o_orderpriority")).alias("msi_type"),
        F.when(_at(h, 17), F.lit(None).cast("double"))
         .when(_at(h, 31), F.lit(-1.0))
         .otherwise(F.col("l_quantity")).alias("mutation_count"),
        F.when(_at(h, 37), F.lit(-1.0)).otherwise(F.col("l_extendedprice") / 1000.0).alias("tmb"),
        F.col("l_discount").alias("fga"),
        F.when(_at(h, 13), F.lit(None).cast("string"))
         .when(_at(h, 97), F.lit("9000"))
         .otherwise(F.round(F.col("l_tax") * 1000).cast("bigint").cast("string")).alias("purity"),
        (F.col("p_retailprice") / 500.0).alias("ploidy"),
        F.when((h % 5) < 2, F.col("p_name")).alias("sparse_note"),
        "h",
        *([F.col("p_partkey").isNull().alias("no_part"), "tied"] if how == "left" else []),
    )


def part_keys_repeat(spark: SparkSession, sf_dir: str) -> bool:
    """Whether part has several rows of one key, so that a sample may meet more than one."""
    pa = _read(spark, sf_dir, "part").where(F.col("p_partkey").isNotNull())
    return not pa.groupBy("p_partkey").count().where(F.col("count") > 1).isEmpty()


RAW_SQL = """
raw_j AS (
  SELECT l.*, o.*, c.c_mktsegment, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS sample_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
raw_h AS (
  SELECT *, ('0x' || substr(md5(sample_id), 1, 8))::BIGINT AS h FROM raw_j
),
raw AS (
  SELECT sample_id,
         l_orderkey AS patient_id,
         CASE WHEN l_returnflag = 'A' THEN 'Primary'
              WHEN l_returnflag = 'R' THEN 'Metastasis' ELSE 'Unknown' END AS sample_type,
         CASE WHEN h % 53 = 0 THEN NULL
              ELSE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30.4375::DOUBLE
         END AS os_months,
         CASE WHEN h % 59 = 0 THEN NULL
              WHEN o_orderstatus = 'F' THEN '1:DECEASED' ELSE '0:LIVING' END AS os_status,
         CASE WHEN h % 61 = 0 THEN NULL ELSE p_brand END AS cancer_type,
         p_type AS subgroup,
         CASE WHEN h % 43 = 0 THEN NULL
              WHEN p_size > 47 THEN '>47' ELSE CAST(p_size AS VARCHAR) END AS age,
         l_linestatus AS sex,
         CASE WHEN h % 11 = 0 THEN NULL ELSE c_mktsegment END AS ancestry,
         CASE WHEN h % 29 = 0 THEN 'nan' ELSE o_orderpriority END AS msi_type,
         CASE WHEN h % 17 = 0 THEN NULL WHEN h % 31 = 0 THEN -1.0::DOUBLE
              ELSE l_quantity END AS mutation_count,
         CASE WHEN h % 37 = 0 THEN -1.0::DOUBLE ELSE l_extendedprice / 1000.0::DOUBLE END AS tmb,
         l_discount AS fga,
         CASE WHEN h % 13 = 0 THEN NULL WHEN h % 97 = 0 THEN '9000'
              ELSE CAST(CAST(round(l_tax * 1000) AS BIGINT) AS VARCHAR) END AS purity,
         p_retailprice / 500.0::DOUBLE AS ploidy,
         CASE WHEN h % 5 < 2 THEN p_name END AS sparse_note,
         h
  FROM raw_h
)"""
