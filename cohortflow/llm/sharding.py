"""Sharding by a Feistel permutation over global row numbers [native].

Every row gets a global number 0..n-1, the keyed permutation moves number i to
p(i), and the row goes to shard p(i) mod S at slot p(i) div S. Shard sizes
differ by one at most and slots have no gaps, whatever the keys, sizes or
copies look like. ``shard_slot`` computes both for any row number without a
lookup, and ``permuted(..., inverse=True)`` gives the row number back.

Nulls: a null doc_id sorts first in its bucket, a null text has size 1 and the
crc32 of the empty text (0). Rows equal in all columns are interchangeable.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, counted, unfolded

ROUNDS = 6
#: Under a = ceil(sqrt n) numbers of the domain lie outside 0..n-1, each met
#: once at most: the bound is proven for a <= 64, beyond it a longer walk has
#: probability below a ** -64 and would raise an error.
WALKS = 64
#: Buckets in which rows are numbered; fixed, so that numbers do not depend on
#: the cluster, and the bound of the offset table that is broadcast.
BUCKETS = 1 << 14


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the domain Z_a x Z_b: a * b >= n and a * b < n + a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def _network(x: Column, a: int, b: int, seed: int, inverse: bool) -> Column:
    """The Feistel network: each round adds a keyed hash of one half to the other,
    modulo the other's side."""
    def mixed(s, r, into, by, side):
        h = F.pmod(F.xxhash64(F.lit(seed), r, s[by]), F.lit(side))
        return F.pmod(s[into] - h if inverse else s[into] + h, F.lit(side))

    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(
        F.array(*[F.lit(r).cast("long") for r in rounds]),
        F.struct((x % F.lit(a)).alias("l"), F.call_function("div", x, F.lit(a)).alias("r")),
        lambda s, r: F.when(r % 2 == 0, F.struct(mixed(s, r, "l", "r", a).alias("l"), s["r"].alias("r")))
        .otherwise(F.struct(s["l"].alias("l"), mixed(s, r, "r", "l", b).alias("r"))),
        lambda s: s["r"] * F.lit(a) + s["l"],
    )


def permuted(number: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """p(number) in 0..n-1: the network is applied until the number is in range
    (cycle walking), so p permutes exactly 0..n-1."""
    a, b = domain(n)
    first = _network(number.cast("long"), a, b, seed, inverse)
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), first,
        lambda v, _: F.when(v < F.lit(n), v).otherwise(_network(v, a, b, seed, inverse)),
    )
    return F.aggregate(
        F.array(end), F.lit(0).cast("long"),
        lambda _, v: F.when(v < F.lit(n), v).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")),
    )


def shard_slot(number: Column, n: int, shards: int, seed: int = 0) -> Column:
    """struct(shard, slot) of a global row number."""
    return F.aggregate(
        F.array(permuted(number, n, seed)),
        F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")),
        lambda _, p: F.struct((p % F.lit(shards)).cast("int").alias("shard"), F.call_function("div", p, F.lit(shards)).alias("slot")),
    )


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number_`` from 0 without gaps, and the row count.

    Equal rows are counted first and cut into blocks of bounded size, so however
    often a row repeats, its copies spread. Blocks go to BUCKETS by a hash of all
    columns and are numbered by the rows before them in the bucket plus those of the
    buckets before; only the bucket counts (BUCKETS at most) reach the driver.
    """
    keys = [*rows.columns, "block_"]
    blocks = checkpoint(counted(rows)).withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    counts = dict(blocks.groupBy("bucket_").agg(F.sum("copies_")).collect())
    offsets, total = [], 0
    for k in sorted(counts):
        offsets.append((k, total))
        total += counts[k]
    at = rows.sparkSession.createDataFrame(offsets, "bucket_ int, offset_ long")
    through = F.sum("copies_").over(Window.partitionBy("bucket_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocks.withColumn("through_", through).join(F.broadcast(at), "bucket_")
    out = ranked.withColumn("row_number_", F.col("offset_") + F.col("through_") - F.col("copies_"))
    return unfolded(out.drop("bucket_", "offset_", "through_"), "row_number_"), total


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number_, shard, slot of every document."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    numbered, n = number_rows(rows)
    placed = numbered.withColumn("at_", shard_slot(F.col("row_number_"), n, shards, seed))
    return placed.select("doc_id", "size", "text_crc32", "row_number_", "at_.shard", "at_.slot")
