"""Streaming repair of generated rows (B21, B27, B28 on ``readStream``).

The repair operators are stateless projections whose parameters come from a
one-off fit on the real table, so the same functions apply to a stream of
generated files: no state store, no watermark, exactly-once through the
file sink's commit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortflow.operators import clean, repair
from cohortflow.schema import DEFAULT, SurvivalSchema


def repair_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                  constraints: DataFrame, sch: SurvivalSchema = DEFAULT,
                  max_files_per_trigger: int = 8) -> DataFrame:
    """A streaming DataFrame: labels normalised (B21), then bounds and integer
    types enforced (B27) on every generated parquet file that lands in
    ``source_dir``."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    out = clean.normalise_labels(src, sch)
    out, _ = repair.enforce_constraints(out, constraints)
    return out


def start_to_parquet(stream: DataFrame, out_dir: str, checkpoint_dir: str, trigger_once: bool = True):
    """Write the repaired stream to parquet; the checkpoint folder (on the
    shared file system) makes restarts exactly-once."""
    w = stream.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
