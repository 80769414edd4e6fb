"""Repair of generated rows (B23-B29, G2): snap, round, clip, cast.

Fits read the real table once (one aggregation for all columns) and return
small parameter tables; applies are single projections over the synthetic
rows, valid in batch and in ``readStream`` alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe, whole
from cohortflow.functions.quantiles import median_map
from cohortflow.operators.clean import is_numeric, nan_to_null

MAX_DECIMALS = 18


def decimals_needed(x: Column) -> Column:
    """Fewest decimals d (0..18) with bround(x, d) == x; null for null."""
    return F.coalesce(*[F.when((F.bround(x, d) if d else whole(x)) == x, F.lit(d)) for d in range(MAX_DECIMALS + 1)],
                      F.lit(MAX_DECIMALS))


def fit_precision(real: DataFrame, cols: Sequence[str], unique_threshold: int = 1000) -> DataFrame:
    """B24/B25 fit: per column: real distinct count, decimals, integer type, and
    the sorted distinct values when there are at most ``unique_threshold``.

    The decimals of every column in one pass, the exact distinct count of every
    column by stacked values; then ``collect_set`` only for the columns within the
    threshold, so a continuous column is never collected value by value.
    """
    cols = [c for c in cols if c in real.columns and is_numeric(real, c)]
    wide = real.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    first = wide.agg(*[F.max(decimals_needed(F.col(c))).alias(f"d__{c}") for c in cols]).first() if cols else {}
    stacked = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("_v")) for c in cols]))) if cols else None
    distinct = dict(stacked.where("_v IS NOT NULL").distinct().groupBy("column").count().collect()) if cols else {}  # a number a column
    small = [c for c in cols if distinct.get(c, 0) <= unique_threshold]
    sets = wide.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in small]).first() if small else {}
    rows = []
    for c in cols:
        vals = list(sets[c]) if c in small else None
        n = len(vals) if vals is not None else distinct[c]
        rows.append((c, n, first[f"d__{c}"], vals if n <= unique_threshold else None,
                     real.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")))
    return real.sparkSession.createDataFrame(
        rows, "column string, real_nuniq bigint, decimals int, values array<double>, real_is_int boolean")


def _number_array(values: Sequence[float]) -> Column:
    """One array literal (folded from text; ``repr`` keeps every bit)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _snapped(x: Column, bucket: Column, values: list[float]) -> Column:
    """Nearest real value, ties to the smaller one; null stays null. ``bucket``
    is the number of real values up to ``x``, so its neighbours are the candidates."""
    n, arr, b = len(values), _number_array(values), bucket.cast("int")
    left = F.when(b > 0, F.get(arr, b - 1))
    right = F.when(b < n, F.get(arr, b))
    return (F.when(x.isNull(), F.lit(None).cast("double")).when(left.isNull(), right).when(right.isNull(), left)
            .when(F.abs(x - left) <= F.abs(x - right), left).otherwise(right))


def _null_groups(syn: DataFrame, cols: Sequence[str], by: Sequence[str]) -> dict[str, Column | None]:
    """Per column: whether a row's group has nulls there (None: no group has).
    Groups are synthetic tables, a handful of names."""
    if not cols:
        return {}
    sums = [F.count_if(nan_to_null(F.col(c).cast("double")).isNull()).alias(c) for c in cols]
    rows = syn.groupBy(*by).agg(*sums).collect()
    holes: dict[str, Column | None] = {}
    for c in cols:
        test = None
        for r in (r for r in rows if r[c]):
            same = F.lit(True)
            for k in by:
                same = same & F.col(k).eqNullSafe(F.lit(r[k]))
            test = same if test is None else test | same
        holes[c] = test
    return holes


def _distinct_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """(by..., column, ``name``: distinct non-null values), by stacked values: what is shuffled
    is a group, a column's name and one value, not a row of all columns for each of them."""
    kinds: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType.simpleString()
        kinds.setdefault("double" if t in ("double", "float") else "bigint" if not t.startswith("decimal") else "string", []).append(c)
    counts = None
    for kind, mine in kinds.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("_v")) for c in mine])
        part = df.select(*by, F.inline(pairs)).where(F.col("_v").isNotNull()).distinct().groupBy(*by, "column").agg(F.count(F.lit(1)).alias("_k"))
        counts = part if counts is None else counts.unionByName(part)
    each = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).select(*by, F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return join_null_safe(each, counts, [*by, "column"], "left").select(*by, "column", F.coalesce("_k", F.lit(0)).alias(name))


def match_precision(syn: DataFrame, params: DataFrame, unique_threshold: int = 1000,
                    skip: Sequence[str] = ("time", "status"), by: Sequence[str] = ()
                    ) -> tuple[DataFrame, DataFrame]:
    """B24/B25 apply: snap low-cardinality columns to real values, round the
    others to the real decimals. Where the real column is integer, each group
    of ``by`` (a synthetic table) without nulls there is rounded to integers;
    the column is long if no group has nulls, else double with whole values in
    those groups. Report: distinct counts before/after and the rule per group
    (",int": cast this group's column to long on export).
    """
    rows = {r["column"]: r for r in params.collect()}
    cols = [c for c in syn.columns if c in rows and c not in skip and is_numeric(syn, c)]
    if not cols:
        return syn, syn.sparkSession.createDataFrame([], "column string, rule string, real_nuniq bigint")
    holes = _null_groups(syn, [c for c in cols if rows[c]["real_is_int"]], by)
    values = {c: sorted(set(rows[c]["values"])) for c in cols
              if rows[c]["real_nuniq"] <= unique_threshold and rows[c]["values"]}
    number = {c: f"_x{i}" for i, c in enumerate(values)}
    bucket = {c: f"_b{i}" for i, c in enumerate(values)}
    out = syn.select("*", *[nan_to_null(F.col(c).cast("double")).alias(number[c]) for c in values])
    many = [c for c in values if len(values[c]) > 1]
    if many:  # one JVM binary search per value
        out = Bucketizer(splitsArray=[[float("-inf"), *values[c], float("inf")] for c in many],
                         inputCols=[number[c] for c in many], outputCols=[bucket[c] for c in many],
                         handleInvalid="keep").transform(out)
    exprs, rule = [], {}
    for c in syn.columns:
        if c not in cols:
            exprs.append(F.col(c))
            continue
        if c in values:
            x = F.col(number[c])
            e = _snapped(x, F.col(bucket[c]), values[c]) if c in many else F.when(x.isNotNull(), F.lit(values[c][0]))
            rule[c] = f"snap:{rows[c]['real_nuniq']}"
        else:
            d = int(rows[c]["decimals"] or 0)
            e = F.bround(nan_to_null(F.col(c).cast("double")), d) if d > 0 else F.col(c)
            rule[c] = f"round:{d}"
        if rows[c]["real_is_int"]:
            near = whole(e.cast("double"))
            e = near.cast("long") if holes[c] is None else F.when(holes[c], e.cast("double")).otherwise(near)
        exprs.append(e.alias(c))
    out = out.select(*exprs)
    report = join_null_safe(_distinct_counts(syn, cols, by, "syn_nuniq_before"), _distinct_counts(out, cols, by, "syn_nuniq_after"), [*by, "column"])
    table = syn.sparkSession.createDataFrame([(c, rule[c], int(rows[c]["real_nuniq"])) for c in cols],
                                             "column string, rule string, real_nuniq bigint")
    report = report.join(F.broadcast(table), "column")  # a row per column
    integer = F.lit(False)
    for c in cols:
        if rows[c]["real_is_int"]:
            integer = integer | ((F.col("column") == c) & (F.lit(True) if holes[c] is None else ~holes[c]))
    return out, report.withColumn("rule", F.when(integer, F.concat("rule", F.lit(",int"))).otherwise(F.col("rule")))


# Default constraints under the derived cohort's column names
# (dtype, lo, hi); the reference's own map names the clinical columns.
DEFAULT_CONSTRAINTS = {
    "age": ("int", 0.0, 120.0),
    "mutation_count": ("int", 0.0, None),
    "fga": ("float", 0.0, 1.0),
    "purity": ("float", 0.0, 100.0),
    "ploidy": ("float", 0.0, None),
    "tmb": ("float", 0.0, None),
    "time": ("float", 1e-3, None),
    "status": ("int", 0.0, 1.0),
}


def resolve_constraints(real: DataFrame, metadata: DataFrame | None = None,
                        defaults: Mapping[str, tuple] | None = None) -> DataFrame:
    """Per real numeric column: metadata entry, else default map, else
    inferred from real (integer if all integer-valued; observed min/max).

    Three small tables joined by column; ``source`` says which one won.
    """
    defaults = DEFAULT_CONSTRAINTS if defaults is None else defaults
    spark = real.sparkSession
    cols = [c for c in real.columns if is_numeric(real, c)]
    aggs = []
    for c in cols:
        x = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"),
                             F.coalesce(F.bool_and(x == whole(x)), F.lit(False)).alias("is_int")).alias(c))
    inferred = real.agg(*aggs).unpivot([], cols, "column", "s").select(
        "column", F.when(F.col("s.is_int"), "int").otherwise("float").alias("i_dtype"),
        F.col("s.lo").alias("i_lo"), F.col("s.hi").alias("i_hi"))
    dft = spark.createDataFrame([(c, d, lo, hi) for c, (d, lo, hi) in defaults.items()],
                                "column string, d_dtype string, d_lo double, d_hi double")
    j = inferred.join(F.broadcast(dft), "column", "left")
    if metadata is not None:
        md = metadata.select("column", F.col("dtype").alias("m_dtype"),
                             F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"), F.lit(True).alias("_m"))
        j = j.join(F.broadcast(md), "column", "left")
    else:
        j = j.select("*", *[F.lit(None).cast(t).alias(n) for n, t in
                            (("m_dtype", "string"), ("m_lo", "double"), ("m_hi", "double"), ("_m", "boolean"))])
    has_m, has_d = F.col("_m").isNotNull(), F.col("d_dtype").isNotNull()
    pick = lambda m, d, i: F.when(has_m, F.col(m)).when(has_d, F.col(d)).otherwise(F.col(i))
    return j.select("column", pick("m_dtype", "d_dtype", "i_dtype").alias("dtype"),
                    pick("m_lo", "d_lo", "i_lo").alias("lo"), pick("m_hi", "d_hi", "i_hi").alias("hi"),
                    F.when(has_m, "json").when(has_d, "default_map").otherwise("inferred").alias("source"))


def enforce_constraints(syn: DataFrame, constraints: DataFrame, by: Sequence[str] = ()
                        ) -> tuple[DataFrame, DataFrame]:
    """Clip to bounds (either end may be open), round half-even and cast
    to long for int columns; report n_below, n_above, n_rounded, pct_modified.

    The constraint table has one row per column, so it is read to the driver
    and becomes literals: one projection for the data, one aggregation
    (partial + final) for the report.
    """
    spec = {r["column"]: r for r in constraints.collect()}
    cols = [c for c in syn.columns if c in spec and is_numeric(syn, c)]
    exprs, aggs = [], []
    for c in syn.columns:
        if c not in cols:
            exprs.append(F.col(c))
            continue
        r = spec[c]
        x = nan_to_null(F.col(c).cast("double"))
        lo, hi = r["lo"], r["hi"]
        y = x
        if lo is not None:
            y = F.when(y < lo, F.lit(float(lo))).otherwise(y)
        if hi is not None:
            y = F.when(y > hi, F.lit(float(hi))).otherwise(y)
        below = F.count_if(x < lo) if lo is not None else F.lit(0)
        above = F.count_if(x > hi) if hi is not None else F.lit(0)
        if r["dtype"] == "int":
            rounded = F.count_if(y != whole(y))
            y = whole(y).cast("long")
        else:
            rounded = F.lit(0)
        exprs.append(y.alias(c))
        aggs.append(F.struct(below.cast("bigint").alias("n_below"), above.cast("bigint").alias("n_above"),
                             rounded.cast("bigint").alias("n_rounded")).alias(c))
    out = syn.select(*exprs)
    if not cols:
        return out, syn.sparkSession.createDataFrame([], "column string")
    rep = syn.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rep = rep.unpivot([*by, "_n"], cols, "column", "s").select(
        *by, "column", "s.n_below", "s.n_above", "s.n_rounded",
        (F.lit(100.0) * (F.col("s.n_below") + F.col("s.n_above") + F.col("s.n_rounded"))
         / F.greatest(F.col("_n"), F.lit(1))).alias("pct_modified"))
    src = constraints.select("column", "dtype", "lo", "hi", *(["source"] if "source" in constraints.columns else []))
    return out, rep.join(F.broadcast(src), "column")


def fit_scale(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D8 fit: (column, mean, std) with the population std (numpy's default)."""
    cols = [c for c in cols if c in train.columns]
    aggs = [F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                     F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in cols]
    return train.agg(*aggs).unpivot([], cols, "column", "s").select("column", "s.mean", "s.std")


def scale(df: DataFrame, params: DataFrame) -> DataFrame:
    """D8 apply: (x - mean) / std; a zero std leaves x - mean."""
    p = {r["column"]: (r["mean"], r["std"]) for r in params.collect()}
    return df.select(*[((F.col(c) - m) / (sd if sd else 1.0)).alias(c) if c in p else F.col(c)
                       for c in df.columns for (m, sd) in [p.get(c, (0.0, 1.0))]])


def decode_standardised(z: DataFrame, params: DataFrame, discrete: Mapping[str, tuple[float, float]],
                        time: str = "time") -> DataFrame:
    """Z-scores back to data units: x = z * std + mean; discrete columns
    rounded half-even and clipped to [lo, hi]; time at least 0."""
    p = {r["column"]: (r["mean"], r["std"]) for r in params.collect()}
    exprs = []
    for c in z.columns:
        if c not in p:
            exprs.append(F.col(c))
            continue
        m, sd = p[c]
        x = F.col(c) * F.lit(float(sd)) + F.lit(float(m))
        if c in discrete:
            lo, hi = discrete[c]
            x = F.bround(x, 0)
            x = F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)
        if c == time:
            x = F.when(x < 0, F.lit(0.0)).otherwise(x)
        exprs.append(x.alias(c))
    return z.select(*exprs)


def reorder(df: DataFrame, order: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Priority columns first, then the training order; only those present."""
    seen, out = set(), []
    for c in list(first) + list(order):
        if c in df.columns and c not in seen:
            seen.add(c)
            out.append(c)
    return df.select(*out)


def median_then_zero_fill(df: DataFrame, codes: DataFrame | None, cols: Sequence[str],
                          medians: Mapping[str, float] | None = None) -> DataFrame:
    """Numericise features. Text columns take the code of a mapping
    shared across tables (fitted on the real table); a null text is -1 (as a
    pandas category code), an unseen text is missing. Then every missing value
    takes the column median -- of this table unless ``medians`` is given -- and
    what is still missing (an all-null column) becomes 0."""
    out = df
    if codes is not None:
        text = [c for c in cols if c in df.columns and not is_numeric(df, c)]
        cmap = {}
        for r in codes.collect():
            cmap.setdefault(r["column"], []).append((r["code"], r["value"]))
        exprs = []
        for c in out.columns:
            if c in text:
                vals = [v for _, v in sorted(cmap.get(c, []))]
                arr = F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<string>")
                pos = F.array_position(arr, F.col(c).cast("string"))
                code = F.when(F.col(c).isNull(), F.lit(-1.0)).when(pos > 0, (pos - 1).cast("double"))
                exprs.append(code.alias(c))
            else:
                exprs.append(F.col(c))
        out = out.select(*exprs)
    num = [c for c in cols if c in out.columns]
    out = out.select(*[nan_to_null(F.col(c).cast("double")).alias(c) if c in num else F.col(c)
                       for c in out.columns])
    if medians is None:
        medians = median_map(out, num)
    return out.select(*[F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double"), F.lit(0.0)).alias(c)
                        if c in num else F.col(c) for c in out.columns])
