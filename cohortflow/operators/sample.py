"""De-duplication, sampling and splitting.

All draws are keyed md5 hashes of a stable row id and the seed (see
``functions.hashing``), never ``rand()``: the same seed gives the same rows
under any partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe
from cohortflow.functions.hashing import TWO_32, hash32, keyed, uniform
from cohortflow.functions.quantiles import grouped_quantiles
from cohortflow.functions.windows import prefix_sum
from cohortflow.session import cut_lineage


def dedupe(df: DataFrame, key: str, prefer: Column, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the first row where ``prefer`` holds, else the first row.

    "First" is by ``order`` (Spark has no input order, so it must be explicit,
    and should be unique within a key). The whole row is packed into a struct
    led by (not prefer, order...) and ``min`` picks it: struct comparison is
    field by field, so the leading fields decide. ``min`` is a combinable
    aggregate -- each task keeps one candidate per key before the shuffle, so
    a patient holding a third of all rows costs one row per task.
    """
    order = list(order)
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(F.when(prefer, F.lit(0)).otherwise(F.lit(1)).alias("_p"),
                      *[F.col(c) for c in order], *[F.col(c) for c in rest])
    picked = df.groupBy(key).agg(F.min(packed).alias("_row"))
    return picked.select(*[(F.col(key) if c == key else F.col(f"_row.{c}")).alias(c) for c in df.columns])


def split_key(id_col: str, seed: int) -> Column:
    """Unit-interval hash of (id, seed), the split / sampling key."""
    return (hash32(keyed(id_col, seed)) + F.lit(0.5)) / F.lit(TWO_32)


def hash_split(df: DataFrame, id_col: str, frac: float = 0.8, seed: int = 42,
               out: str = "is_train") -> DataFrame:
    """C2 (scale default): train when hash(id, seed) < frac. No shuffle at all;
    every stratum is split at ``frac`` in expectation."""
    return df.withColumn(out, split_key(id_col, seed) < F.lit(float(frac)))


def stratified_split(df: DataFrame, by: Sequence[str], id_col: str, frac: float = 0.8,
                     seed: int = 42, out: str = "is_train") -> DataFrame:
    """C2 exact: per stratum, the ``floor(frac * n)`` rows with the smallest
    hash(id, seed) go to train.

    The within-stratum rank is a distributed prefix count (range partitions,
    no single-partition window), so a 2-valued stratum never lands in 2 tasks.
    """
    by = list(by)
    keyed_df = df.withColumn("_u", split_key(id_col, seed)).withColumn("_one", F.lit(1))
    ranked = prefix_sum(keyed_df, by, ["_u", id_col], ["_one"], out_prefix="_rank")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    j = join_null_safe(ranked, sizes, by)
    return (j.withColumn(out, F.col("_rank_one") <= F.floor(F.col("_n") * float(frac)))
            .drop("_u", "_one", "_rank_one", "_n"))


def cap_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the n smallest hash(id, seed), by a distributed rank: the
    kept rows stay spread over the cluster. ``n`` is the feature."""
    return hash_ranked(df, id_col, seed).where(F.col("_rank") <= n).drop("_rank")


def hash_ranked(df: DataFrame, id_col: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``_rank`` from 1 by (hash(id, seed), id) within ``by``: a sliced running
    count, so the n first rows stay spread over the cluster."""
    keyed_df = df.withColumn("_u", split_key(id_col, seed)).withColumn("_one", F.lit(1))
    ranked = prefix_sum(keyed_df, by, ["_u", id_col], ["_one"], out_prefix="_cum")
    return ranked.withColumnRenamed("_cum_one", "_rank").drop("_u", "_one")


#: Bits of the hash that tell a row's cell: cells are counted, only rows of cut or drawn cells are ranked.
CELL_BITS = 16
#: Row numbers of a block, by which a drawn row number finds its cell.
CELL_BLOCK = 256


def _cells(df: DataFrame, by: Sequence[str], id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with hash ``_h`` and ``_cell`` (its upper bits), and per (by, cell) the rows
    ``_n`` and ``_before`` (in lower cells of the group). Rows are not moved; a null id,
    which is the first, is in cell -1."""
    h = hash32(keyed(id_col, seed))
    rows = df.withColumn("_h", h).withColumn("_cell", F.coalesce(F.shiftright("_h", 32 - CELL_BITS), F.lit(-1).cast("long")))
    cells = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    return rows, prefix_sum(cells, by, ["_cell"], ["_n"], inclusive=False, out_prefix="_before").withColumnRenamed("_before_n", "_before")


def least_hashed(df: DataFrame, sizes: Sequence[tuple], id_col: str, seed: int, by: str) -> DataFrame:
    """Of each group (value of ``by``, n) of ``sizes`` the n rows of least (hash(id, seed), id).

    Cells of the hash are counted; rows of cells below the one that holds the n-th row are
    taken as they are, and only that cell's rows are ranked."""
    rows, cells = _cells(df, [by], id_col, seed)
    most = F.lit(0)
    for g, n in sizes:
        most = F.when(F.col(by).eqNullSafe(F.lit(g)), F.lit(n)).otherwise(most)
    cut = cells.where((F.col("_before") < most) & (F.col("_before") + F.col("_n") >= most)).select(by, "_cell", "_before").collect()  # a row a group
    found = {r[by]: r for r in cut}
    whole = mixed = F.lit(False)
    left = F.lit(0)
    for g, n in sizes:
        mine = F.col(by).eqNullSafe(F.lit(g))
        if g not in found:  # fewer than n rows
            whole = whole | (mine if n else F.lit(False))
            continue
        whole = whole | (mine & (F.col("_cell") < found[g]["_cell"]))
        mixed = mixed | (mine & (F.col("_cell") == found[g]["_cell"]))
        left = F.when(mine, F.lit(n - found[g]["_before"])).otherwise(left)
    w = Window.partitionBy(by).orderBy("_h", id_col)
    ranked = rows.where(mixed).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= left)
    return rows.where(whole).select(*df.columns).unionByName(ranked.select(*df.columns))


def match_sizes(real: DataFrame, syn: DataFrame, id_real: str, id_syn: str, seed: int = 42,
                method: str = "method") -> tuple[DataFrame, DataFrame]:
    """C3 for a set of synthetic tables: each is compared with ``real`` at
    min(|real|, |table|) rows, the larger side down-sampled without replacement.
    Both results carry ``method``. Sizes (a row per method) become a literal list."""
    n_real = real.count()
    sizes = [(r[method], min(n_real, r["count"])) for r in syn.groupBy(method).count().collect()]
    if not sizes:
        return real.limit(0).select(F.lit(None).cast("string").alias(method), "*"), syn
    each = F.explode(F.array(*[F.lit(m).cast("string") for m, _ in sizes])).alias(method)
    a = least_hashed(real.select(each, *[c for c in real.columns if c != method]), sizes, id_real, seed, method)
    return a.select(method, *real.columns), least_hashed(syn, sizes, id_syn, seed, method)


def match_size(a: DataFrame, b: DataFrame, id_a: str, id_b: str, seed: int = 42
               ) -> tuple[DataFrame, DataFrame]:
    """Down-sample the larger table to min(|a|, |b|) rows without replacement."""
    na, nb = a.count(), b.count()
    n = min(na, nb)
    cut = lambda d, i: hash_ranked(d, i, seed).where(F.col("_rank") <= n).drop("_rank")
    return (cut(a, id_a) if na > n else a), (cut(b, id_b) if nb > n else b)


def subsample(df: DataFrame, n: int, id_col: str, seed: int = 42, side: str = "x", by: str | None = None) -> DataFrame:
    """C4: ``n`` rows (of each ``by`` value); without replacement where there are
    enough rows, else with.

    Rows have a dense rank by hash from a sliced running count. With replacement,
    slot j in 0..n-1 takes rank floor(u_j * N); the draws join on (group, rank),
    an equi-join without a collect. Group sizes (a row per group) become a
    literal list.
    """
    group = F.col(by) if by else F.lit(0)
    d = df.withColumn("_g", group.cast("string"))
    sizes = [(r["_g"], r["count"]) for r in d.groupBy("_g").count().collect()]
    ranked = hash_ranked(d, id_col, seed, ["_g"] if by else [])
    enough = [g for g, t in sizes if t >= n]
    few = [(g, t) for g, t in sizes if t < n]
    among = F.lit(False)
    for g in enough:
        among = among | F.col("_g").eqNullSafe(F.lit(g).cast("string"))
    out = ranked.where(among & (F.col("_rank") <= n)).select(*df.columns)
    if few:
        groups = F.array(*[F.struct(F.lit(g).cast("string").alias("_g"), F.lit(t).alias("_t")) for g, t in few])
        draws = df.sparkSession.range(n).select("id", F.inline(groups)).select(
            "_g", (F.floor(uniform(F.col("id"), f"subsample:{side}", seed) * F.col("_t")) + 1).cast("long").alias("_rank"))
        out = out.unionByName(join_null_safe(draws, ranked, ["_g", "_rank"]).select(*df.columns))
    return out




def balanced_weights(df: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """C6 (S part): per label class: count and sampling weight 1/count."""
    return (df.groupBy(*label_cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .withColumn("weight", F.lit(1.0) / F.col("n")))


def balanced_resample(df: DataFrame, label_cols: Sequence[str], n: int, id_col: str,
                      seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows with replacement, each class drawn equally often.

    Slot j in 0..n-1 draws a class (of the K classes in label order) and a row
    of it by two hashed uniforms; the rows of a class are numbered by (hash, id).
    Cells of the hash are counted, a slot's row number tells its cell, and only rows of
    drawn cells are numbered. Both joins are equi-joins, whose repeated keys are all on
    the slots' side, where adaptive execution can split them. Each row carries its
    ``slot``. Null labels are a class; an empty table gives no rows.
    """
    labels = list(label_cols)
    classes = balanced_weights(df, labels)
    order = Window.partitionBy(F.lit(0)).orderBy(*labels)  # one row per class
    classes = cut_lineage(classes.withColumn("_class", F.row_number().over(order) - 1))
    k = classes.count()
    slots = df.sparkSession.range(n).select(
        F.col("id").alias("slot"),
        F.floor(uniform(F.col("id"), "balanced:class", seed) * k).cast("int").alias("_class"),
        uniform(F.col("id"), "balanced:row", seed).alias("_at"))
    slots = slots.join(classes.select("_class", "n"), "_class").select(
        "slot", "_class", F.floor(F.col("_at") * F.col("n")).cast("long").alias("_row"))
    rows = join_null_safe(df, classes.select(*labels, "_class"), labels)
    rows, cells = _cells(rows, ["_class"], id_col, seed)
    # a cell is found by the blocks of row numbers that it touches
    cells = cells.select("_class", "_cell", "_n", "_before", F.explode(F.sequence(
        F.floor(F.col("_before") / CELL_BLOCK), F.floor((F.col("_before") + F.col("_n") - 1) / CELL_BLOCK))).alias("_block"))
    slots = slots.withColumn("_block", F.floor(F.col("_row") / CELL_BLOCK)).join(cells, ["_class", "_block"])
    at = F.col("_row") - F.col("_before")
    slots = cut_lineage(slots.where((at >= 0) & (at < F.col("_n"))).select("slot", "_class", "_cell", at.alias("_at")))
    drawn = slots.select("_class", "_cell").distinct()
    w = Window.partitionBy("_class", "_cell").orderBy("_h", id_col)
    rows = rows.join(drawn, ["_class", "_cell"], "left_semi").withColumn("_at", (F.row_number().over(w) - 1).cast("long")).drop("_h")
    return slots.join(rows, ["_class", "_cell", "_at"]).drop("_class", "_cell", "_at")


def cycle(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Repeat ``df`` in ``order`` until ``n`` rows; row i of the output is
    row i mod |df|. The input gets a dense index from a distributed prefix
    count; the output rows come from ``spark.range(n)`` and join on the index."""
    m = df.count()
    if m == 0:
        return df.limit(0).withColumn("row_idx", F.lit(0).cast("long"))
    idx = prefix_sum(df.withColumn("_one", F.lit(1)), [], list(order), ["_one"], out_prefix="_i")
    idx = idx.withColumn("_src", F.col("_i_one") - 1).drop("_one", "_i_one")
    out = df.sparkSession.range(n).select(F.col("id").alias("row_idx"), (F.col("id") % m).alias("_src"))
    return out.join(idx, "_src").drop("_src")


def bootstrap_summary(runs: DataFrame, metric: str = "metric", value: str = "value",
                      by: Sequence[str] = ()) -> DataFrame:
    """Over replicates: mean, sample std (0 for one run), 2.5/97.5 % quantiles, n.

    Non-finite values are dropped first. ``runs`` is a long table
    (by..., metric, b, value) so all replicates are summarised in one job.
    """
    v = F.col(value)
    finite = runs.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    stats = finite.groupBy(*by, metric).agg(
        F.avg(v).alias("boot_mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("boot_std"),
        F.count(v).cast("bigint").alias("boot_n"),
    )
    q = grouped_quantiles(finite, [*by, metric], [0.025, 0.975], value=value)
    return join_null_safe(stats, q, [*by, metric]).select(
        *by, metric, "boot_mean", "boot_std", F.col("q")[0].alias("boot_ci_lo"), F.col("q")[1].alias("boot_ci_hi"), "boot_n")


def cap_rows_by(df: DataFrame, n: int, id_col: str, by: str, seed: int = 42) -> DataFrame:
    """C5 per group: at most ``n`` rows of every ``by`` value, the n smallest
    hash(id, seed). A per-group top-n (``row_number`` over the hash; Spark's
    window group limit keeps n rows per group before the shuffle's sort)."""
    w = Window.partitionBy(by).orderBy("_u", id_col)
    return (df.withColumn("_u", split_key(id_col, seed)).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).drop("_u", "_rn"))
