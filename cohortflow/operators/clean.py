"""Projection, filter and cleaning operators.

Rule for every ``fit_*``: the statistics come from the training split only
and are applied to train and test alike. A fit is one aggregation action that
returns a small parameter DataFrame (columns x values); ``apply`` functions
turn the parameters into column expressions, so the big tables are never
collected and every apply stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.exprs import join_null_safe, whole
from cohortflow.functions.quantiles import column_quantiles, grouped_quantiles
from pyspark.sql import types as T

from cohortflow.schema import DEFAULT, SurvivalSchema

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


def is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))


def nan_to_null(c: Column) -> Column:
    """pandas NaN and SQL NULL mean the same here; Spark orders NaN last."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def zero_sign(c: Column) -> Column:
    """Fold -0.0 into 0.0 (both engines print and hash them differently)."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


# ---------------------------------------------------------------- B1-B5 -----

def require_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: drop rows lacking any of ``cols`` (time / status)."""
    return df.na.drop(subset=list(cols))


def parse_event(df: DataFrame, col: str, out: str = "status", event_prefix: str = "1") -> DataFrame:
    """B2: ``'1:DECEASED' -> 1``, anything else -> 0 (prefix test)."""
    return df.withColumn(out, F.col(col).startswith(event_prefix).cast("int"))


def parse_time(df: DataFrame, col: str, out: str = "time", drop: Iterable[str] = ()) -> DataFrame:
    """Months as double; drop the raw label columns."""
    return df.withColumn(out, F.col(col).cast("double")).drop(*drop)


def valid_time(df: DataFrame, sch: SurvivalSchema = DEFAULT, lo: float = 0.0,
               hi: float = 600.0) -> DataFrame:
    """Keep ``lo < time < hi`` (strict both ends). Pushed to the scan when possible."""
    t = F.col(sch.time)
    return df.where((t > lo) & (t < hi))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop named columns; unknown names are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def label_survival(df: DataFrame, time_raw: str, status_raw: str,
                   sch: SurvivalSchema = DEFAULT) -> DataFrame:
    """B1-B4 in the reference's order: require labels, parse, drop raw, valid range."""
    df = require_labels(df, [time_raw, status_raw])
    df = parse_event(df, status_raw, sch.status)
    df = parse_time(df, time_raw, sch.time, drop=[time_raw, status_raw])
    return valid_time(df, sch)


# ---------------------------------------------------------------- B6-B7 -----

def to_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text to double; text that does not parse (``'>89'``, ``'NA'``) -> NULL."""
    out = df
    for c in cols:
        if c in out.columns:
            out = out.withColumn(c, nan_to_null(F.col(c).try_cast("double")))
    return out


def null_token(df: DataFrame, cols: Iterable[str], token: str = "nan") -> DataFrame:
    """The literal text ``'nan'`` -> NULL."""
    out = df
    for c in cols:
        if c in out.columns:
            out = out.withColumn(c, F.nullif(F.col(c).cast("string"), F.lit(token)))
    return out


# ---------------------------------------------------------------- B8 --------

def fit_top_n(train: DataFrame, col: str, n: int = 15) -> DataFrame:
    """B8 fit: the ``n`` most frequent non-null values (ties by value).

    The result has at most ``n`` rows; it is a top-k report by design.
    """
    return (train.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)).limit(n)
            .select(F.col(col).alias("value"), F.col("count").alias("train_count")))


def bucket_top_n(df: DataFrame, col: str, top: DataFrame, other: str = "Other") -> DataFrame:
    """B8 apply: values outside ``top`` -- and nulls -- become ``other``.

    ``top`` holds at most n rows (a top-n list, proven bound): its values
    become an ``isin`` literal, so the apply is a projection, not a join.
    """
    keep = [r["value"] for r in top.select("value").collect()]
    return df.withColumn(col, F.when(F.col(col).isin(keep), F.col(col)).otherwise(F.lit(other)))


# ---------------------------------------------------------------- B9-B10 ----

def clip_range(df: DataFrame, col: str, lo: float | None, hi: float | None) -> DataFrame:
    """Clip into [lo, hi]; NULL stays NULL (least/greatest skip nulls, so guard)."""
    c = F.col(col)
    e = c
    if lo is not None:
        e = F.when(e < lo, F.lit(float(lo))).otherwise(e)
    if hi is not None:
        e = F.when(e > hi, F.lit(float(hi))).otherwise(e)
    return df.withColumn(col, e)


def count_out_of_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """B9 report: rows below lo / above hi."""
    c = F.col(col)
    return df.agg(F.lit(col).alias("column"),
                  F.count_if(c < lo).cast("bigint").alias("n_below"),
                  F.count_if(c > hi).cast("bigint").alias("n_above"))


def fit_quantile_bounds(train: DataFrame, cols: Sequence[str], q: float = 0.99,
                        lo: float = 0.0) -> DataFrame:
    """B10 fit: exact quantiles of all columns in one plan -> (column, lo, hi);
    a column without values has a null hi."""
    cols = [c for c in cols if c in train.columns]
    if not cols:
        return train.sparkSession.createDataFrame([], "column string, lo double, hi double")
    found = column_quantiles(train, cols, [q])
    return (_one_row_each(train, cols).join(found, "column", "left")
            .select("column", F.lit(float(lo)).alias("lo"), F.col("q")[0].alias("hi")))


def _one_row_each(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in cols], "column string")


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip many columns in one projection from a {column: (lo, hi)} map."""
    exprs = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            e = F.col(c)
            if lo is not None:
                e = F.when(e < lo, F.lit(float(lo))).otherwise(e)
            if hi is not None:
                e = F.when(e > hi, F.lit(float(hi))).otherwise(e)
            exprs.append(e.alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def bounds_map(params: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Bring a (column, lo, hi) table -- one row per column -- to the driver."""
    return {r["column"]: (r["lo"], r["hi"]) for r in params.collect()}


# ---------------------------------------------------------------- B11-B12 ---

def missing_profile(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Per column with nulls: proportion and type, largest first.

    One aggregation over all columns, then ``unpivot`` to a long table.
    NaN counts as missing for floating columns.
    """
    cols = [c for c in df.columns if c not in exclude]
    aggs = []
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.avg(miss.cast("double")).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot([], cols, "var", "proportion")
    types = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString()) for c in cols], "var string, dtype string")
    return (long.where(F.col("proportion") > 0)
            .join(F.broadcast(types), "var")
            .select("var", "proportion", "dtype")
            .orderBy(F.desc("proportion"), F.asc("var")))


def sparse_columns(profile: DataFrame, threshold: float = 0.40) -> list[str]:
    """B12 decision: names with missing share above ``threshold`` (one row per column)."""
    return [r["var"] for r in profile.where(F.col("proportion") > threshold).select("var").collect()]


def drop_sparse(df: DataFrame, profile: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Drop columns whose train missing share exceeds ``threshold``."""
    return drop_columns(df, sparse_columns(profile, threshold))


# ---------------------------------------------------------------- B13-B16 ---

def integer_columns_check(train: DataFrame, candidates: Iterable[str]) -> DataFrame:
    """(column, n_non_null, is_integer) -- every non-null equals its round."""
    cands = [c for c in candidates if c in train.columns]
    aggs = []
    for c in cands:
        x = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.struct(F.count(x).alias("n"),
                             F.coalesce(F.bool_and(x == whole(x)), F.lit(True)).alias("ok")).alias(c))
    wide = train.agg(*aggs)
    long = wide.unpivot([], cands, "column", "s")
    return long.select("column", F.col("s.n").cast("bigint").alias("n_non_null"),
                       ((F.col("s.n") > 0) & F.col("s.ok")).alias("is_integer"))


def integer_columns(train: DataFrame, candidates: Iterable[str]) -> list[str]:
    cands = [c for c in candidates if c in train.columns]
    if not cands:
        return []
    ok = {r["column"] for r in integer_columns_check(train, cands).where("is_integer").collect()}
    return [c for c in cands if c in ok]


def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B14 fit: (column, median), exact; null for a column without values."""
    cols = [c for c in cols if c in train.columns]
    if not cols:
        return train.sparkSession.createDataFrame([], "column string, median double")
    found = column_quantiles(train, cols, [0.5])
    return _one_row_each(train, cols).join(found, "column", "left").select("column", F.col("q")[0].alias("median"))


def medians_map(params: DataFrame) -> dict[str, float]:
    return {r["column"]: r["median"] for r in params.collect()}


def impute_median(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """B14 apply: numeric nulls (and NaN) -> train median."""
    exprs = []
    for c in df.columns:
        if c in medians and medians[c] is not None:
            exprs.append(F.coalesce(nan_to_null(F.col(c).cast("double")),
                                    F.lit(float(medians[c]))).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def impute_constant(df: DataFrame, cols: Iterable[str], value: str = "Unknown") -> DataFrame:
    """String nulls -> ``value``."""
    present = [c for c in cols if c in df.columns]
    return df.na.fill(value, subset=present) if present else df


def restore_int(df: DataFrame, cols: Iterable[str], medians: Mapping[str, float]) -> DataFrame:
    """Refill nulls with the train median, round half to even, cast to long."""
    out = df
    for c in cols:
        if c in out.columns:
            fb = medians.get(c)
            fb = 0.0 if fb is None else float(fb)
            x = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(fb))
            out = out.withColumn(c, whole(x).cast("long"))
    return out


# ---------------------------------------------------------------- B17-B18 ---

def categorical_profile(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Distinct count incl. null per string column, largest first."""
    cols = [c for c in df.columns if c not in exclude and is_string(df, c)]
    if not cols:
        return df.sparkSession.createDataFrame([], "var string, nunique bigint")
    aggs = [(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).cast("bigint").alias(c)
            for c in cols]
    return (df.agg(*aggs).unpivot([], cols, "var", "nunique")
            .orderBy(F.desc("nunique"), F.asc("var")))


def fit_label_codes(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B18 fit: (column, value, code) -- sorted classes, code = rank - 1.

    Stacks all columns into (column, value) and ranks distinct values per
    column: a window partitioned by column over distinct values only, i.e. at
    most the category count per task.
    """
    cols = [c for c in cols if c in train.columns]
    stacked = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    distinct = stacked.where(F.col("value").isNotNull()).distinct()
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("value")
    return distinct.select("column", "value", (F.row_number().over(w) - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, codes: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B18 apply: value -> code; unseen values fall back to class[0] = code 0.

    Each column joins its slice of ``codes``; adaptive execution broadcasts a
    slice whose measured size is small.
    """
    if cols is None:
        cols = [r["column"] for r in codes.select("column").distinct().collect()]
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        m = (codes.where(F.col("column") == c)
             .select(F.col("value").alias("_lv"), F.col("code").alias("_lc")))
        out = (out.join(m, out[c].cast("string") == m["_lv"], "left")
               .withColumn(c, F.coalesce(F.col("_lc"), F.lit(0)).cast("long"))
               .drop("_lv", "_lc"))
    return out


def label_encode_literal(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """B18 apply with the sorted classes as literals: code = position - 1;
    unseen (or null) -> 0. A projection -- no join -- for category lists
    known to be small (the text columns that survive cleaning)."""
    exprs = []
    for c in df.columns:
        if c in values:
            arr = F.array(*[F.lit(v) for v in values[c]]) if values[c] else F.array().cast("array<string>")
            pos = F.array_position(arr, F.col(c).cast("string"))
            exprs.append(F.when(pos > 0, pos - 1).otherwise(F.lit(0)).cast("long").alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


# ---------------------------------------------------------------- B19-B20 ---

def qc_check(df: DataFrame, sch: SurvivalSchema = DEFAULT) -> DataFrame:
    """One aggregation: rows, nulls anywhere, bad time, bad status, event rate."""
    any_null = F.lit(False)
    for c in df.columns:
        x = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            x = x | F.isnan(F.col(c))
        any_null = any_null | x
    t, s = F.col(sch.time), F.col(sch.status)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).cast("int").alias("n_cols"),
        F.count_if(any_null).cast("bigint").alias("n_rows_with_null"),
        F.count_if(~(t > 0)).cast("bigint").alias("n_bad_time"),
        F.count_if(~s.isin(0, 1)).cast("bigint").alias("n_bad_status"),
        F.avg(s.cast("double")).alias("event_rate"),
    )


def assert_qc(report: DataFrame) -> None:
    r = report.first()
    if r["n_rows_with_null"] or r["n_bad_time"] or r["n_bad_status"]:
        raise ValueError(f"QC failed: {r.asDict()}")


# The semantic bounds of the clean cohort under the derived
# cohort's column names.
SEMANTIC_BOUNDS = {
    "fga": (0.0, 1.0),
    "purity": (0.0, 100.0),
    "ploidy": (0.0, None),
    "tmb": (0.0, None),
    "mutation_count": (0.0, None),
    "time": (1e-3, None),
    "age": (0.0, 120.0),
}


def column_metadata(train: DataFrame, semantic: Mapping[str, tuple] | None = None,
                    integer_cols: Sequence[str] = ()) -> DataFrame:
    """Per column dtype and the tighter of observed and semantic bounds.

    One min/max aggregation over all numeric columns -> ``unpivot`` -> join
    with the literal semantic table -> ``greatest`` / ``least``.
    """
    semantic = SEMANTIC_BOUNDS if semantic is None else semantic
    cols = [c for c in train.columns if is_numeric(train, c)]
    aggs = []
    for c in cols:
        x = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(c))
    long = train.agg(*aggs).unpivot([], cols, "column", "b").select("column", "b.lo", "b.hi")
    sem_rows = [(c, None if lo is None else float(lo), None if hi is None else float(hi))
                for c, (lo, hi) in semantic.items()]
    sem = train.sparkSession.createDataFrame(sem_rows, "column string, sem_lo double, sem_hi double")
    ints = set(integer_cols)
    kinds = train.sparkSession.createDataFrame(
        [(c, "int" if (c in ints or isinstance(train.schema[c].dataType, INTEGRAL_TYPES)) else "float")
         for c in cols], "column string, dtype string")
    j = long.join(F.broadcast(sem), "column", "left").join(F.broadcast(kinds), "column")
    return j.select(
        "column", "dtype",
        F.when(F.col("sem_lo").isNull(), F.col("lo")).otherwise(F.greatest("lo", "sem_lo")).alias("lo"),
        F.when(F.col("sem_hi").isNull(), F.col("hi")).otherwise(F.least("hi", "sem_hi")).alias("hi"),
    )


# ---------------------------------------------------------------- B21-B22 ---

def normalise_labels(df: DataFrame, sch: SurvivalSchema = DEFAULT, time_floor: float = 1e-3) -> DataFrame:
    """Status -> round half-even, clip to 0..1, int; time floored at 1e-3."""
    out = df
    if sch.status in df.columns:
        s = whole(F.col(sch.status).cast("double"))
        s = F.when(s < 0, F.lit(0.0)).when(s > 1, F.lit(1.0)).otherwise(s)
        out = out.withColumn(sch.status, s.cast("int"))
    if sch.time in df.columns:
        t = F.col(sch.time).cast("double")
        out = out.withColumn(sch.time, F.when(t < time_floor, F.lit(time_floor)).otherwise(t))
    return out


def real_time_range(real: DataFrame, sch: SurvivalSchema = DEFAULT) -> DataFrame:
    """(tmin, tmax) of the real time column, floored like the reference: tmin >= 1e-3,
    tmax >= 1.01 * tmin."""
    t = F.col(sch.time)
    b = real.agg(F.min(t).alias("tmin"), F.max(t).alias("tmax"))
    tmin = F.greatest(F.col("tmin"), F.lit(1e-3))
    return b.select(tmin.alias("tmin"), F.greatest(F.col("tmax"), tmin * 1.01).alias("tmax"))


def _clip_time(syn: DataFrame, tmin: float, tmax: float, sch: SurvivalSchema) -> DataFrame:
    t = F.col(sch.time)
    return syn.withColumn(sch.time, F.when(t < tmin, F.lit(tmin)).when(t > tmax, F.lit(tmax)).otherwise(t))


def clip_time(syn: DataFrame, real: DataFrame, sch: SurvivalSchema = DEFAULT) -> DataFrame:
    """B22 without its report: only the real range is read."""
    r = real_time_range(real, sch).first()
    return _clip_time(syn, float(r["tmin"]), float(r["tmax"]), sch)


def clip_time_to_real(syn: DataFrame, real: DataFrame, sch: SurvivalSchema = DEFAULT,
                      by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Clip synthetic time into the real [min, max]; report below/above/quantiles.

    The real range is one aggregation (a fit); its two numbers become
    literals, so the clip is a plain projection and the report one grouped
    aggregation (partial + final) over the synthetic rows.
    """
    r = real_time_range(real, sch).first()
    tmin, tmax = float(r["tmin"]), float(r["tmax"])
    t = F.col(sch.time)
    clipped = _clip_time(syn, tmin, tmax, sch)
    report = syn.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(t < tmin).cast("bigint").alias("n_below"),
        F.count_if(t > tmax).cast("bigint").alias("n_above"),
    )
    q = grouped_quantiles(syn, by, [0.01, 0.5, 0.99], value=sch.time)
    if by:
        report, found = join_null_safe(report, q, by, "left"), F.col("q")
    else:  # one row
        found = F.lit((q.first() or [[None] * 3])[0])
    names = [found[i].alias(n) for i, n in enumerate(("q01", "q50", "q99"))]
    return clipped, report.select(*[c for c in report.columns if c != "q"], *names)
