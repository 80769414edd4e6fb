"""Sources and sinks (A1-A7): CSV/Parquet/JSON at the edges, Parquet between stages.

Paths are arguments. Scratch output goes under the cluster's shared
``spark.checkpoint.dir`` (``scratch_dir``), never a machine-local folder.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.session import ensure_checkpoint_dir

METADATA_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("time_column", T.StringType()),
    T.StructField("status_column", T.StringType()),
    T.StructField("is_integer", T.BooleanType()),
])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return posixpath.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:12]}")


def read_cohort(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                fmt: str = "csv") -> DataFrame:
    """A1: read a cohort file; header names are stripped of blanks.

    Production reads pass an explicit schema (no inference pass over the data).
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        r = spark.read.option("header", True)
        df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_cohort(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: Sequence[str] = ()) -> str:
    """A2: write a train/test/synthetic table (Parquet by default, CSV at the edges)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_metadata(meta: DataFrame, path: str, time_col: str = "time", status_col: str = "status",
                   integer_columns: Sequence[str] = ()) -> str:
    """A3 write: the column-metadata sidecar as JSON lines (one per column)."""
    ints = set(integer_columns)
    out = meta.select("column", "dtype", F.col("lo").cast("double"), F.col("hi").cast("double"),
                      F.lit(time_col).alias("time_column"), F.lit(status_col).alias("status_column"),
                      (F.col("column").isin(list(ints)) | (F.col("dtype") == "int")).alias("is_integer"))
    out.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A3 read: the sidecar with its declared schema (no inference)."""
    return spark.read.schema(METADATA_SCHEMA).json(path)


def find_metadata(spark: SparkSession, input_path: str) -> DataFrame | None:
    """A3 discovery: the sidecar next to an input, ``<stem>_metadata.json`` first, then
    ``column_metadata.json`` in the same folder; None if there is neither."""
    from pyspark.errors import AnalysisException

    folder, name = posixpath.split(input_path.rstrip("/"))
    for side in (f"{name.rsplit('.', 1)[0]}_metadata.json", "column_metadata.json"):
        try:
            return read_metadata(spark, posixpath.join(folder, side))
        except AnalysisException:
            continue
    return None


def read_methods(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None,
                 method: str = "method") -> DataFrame:
    """A4: every synthetic table in a folder, one ``method`` per file.

    A folder partitioned by method (``method=<name>/``) yields the column by partition
    discovery; else every entry of the folder is a method, a file ``<name>.csv`` or a
    folder of that name with part files, and its stem is the method's name.
    """
    import re

    r = spark.read
    if fmt == "csv":
        r = r.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    load = r.csv if fmt == "csv" else r.parquet
    if _partitioned(spark, path, method):
        return load(path)
    df = load(posixpath.join(path, "*"))
    inside = F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(posixpath.basename(path.rstrip('/')))}/([^/]+)", 1)
    return df.withColumn(method, F.url_decode(F.regexp_replace(inside, r"\.[A-Za-z0-9]+$", "")))


def _partitioned(spark: SparkSession, path: str, method: str) -> bool:
    """Whether the folder has a ``method=<name>`` entry (one listing, by the path's own file system)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(jvm.org.apache.hadoop.fs.Path(at, f"{method}=*"))
    return found is not None and len(found) > 0


def align_columns(real: DataFrame, syn: DataFrame, keep: Sequence[str] = ()
                  ) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Columns common to both, in the real table's order; the real columns
    missing from the synthetic one are reported. ``keep`` names key columns
    (method, row id) carried on the synthetic side."""
    common = [c for c in real.columns if c in syn.columns and c not in keep]
    missing = [c for c in real.columns if c not in syn.columns]
    return real.select(*common), syn.select(*[k for k in keep if k in syn.columns], *common), common, missing


def write_metrics(metrics: DataFrame, path: str, digits: int = 5) -> str:
    """A5: the long metric table, partitioned by (method, vs); values rounded for export."""
    out = metrics.withColumn("value", F.round(F.col("value").cast("double"), digits))
    parts = [c for c in ("method", "vs") if c in out.columns]
    out.write.mode("append").partitionBy(*parts).parquet(path)
    return path


def save_fitted(tables: dict[str, DataFrame], path: str) -> str:
    """A6 save: every fitted parameter table as Parquet under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(posixpath.join(path, name))
    return path


def load_fitted(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """A6 load: the parameter tables back, to generate or repair without a refit."""
    return {n: spark.read.parquet(posixpath.join(path, n)) for n in names}
