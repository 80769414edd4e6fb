"""Small shared helpers: table readers, checkpoints, text batches."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import cut_lineage

#: Rows handed to numpy code at a time; bounds the Python memory of a task.
SLICE_ROWS = 256
#: Equal rows that stay together where rows are numbered.
COPIES = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that spark.checkpoint.dir names."""
    return cut_lineage(df)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def slices(batch, rows: int = SLICE_ROWS) -> Iterator:
    """Consecutive pieces of an Arrow record batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies_``, COPIES at most: rows that repeat more often are several
    blocks, told apart by ``block_``, so that they hash apart. Null values are equal."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ - 1) div {COPIES}"))).alias("block_")
    every = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_")).select("*", blocks)
    return every.select(*rows.columns, "block_", F.least(F.lit(COPIES), F.col("n_") - F.col("block_") * COPIES).alias("copies_"))


def unfolded(blocks: DataFrame, first: str) -> DataFrame:
    """The rows behind ``blocks`` of ``counted``; column ``first``, the number of a block's
    first row, counts on over its copies."""
    n = F.explode(F.sequence(F.col(first), F.col(first) + F.col("copies_") - 1))
    return blocks.withColumn(first, n).drop("block_", "copies_")
