"""Quality rules: robust multivariate outliers among the statistics of documents.

Every document gets five statistics of its whole text and from them a vector:
log of the word count, log of the mean word length, log of the symbols per
hundred words, log of the repeated lines, share of the repeated words. For each
(lang, source) the minimum covariance determinant names centre and scatter of
the documents that pass the base rules: of the subsets that hold a share
``SHARE`` of them, the one of least determinant that C-steps reach from two
deterministic starts (medians with absolute deviations; medians with the
covariance of the directions from them). A document is rejected if its
Mahalanobis distance from its group passes the chi-square quantile ``LEVEL``.

All of it is counted over all documents, none is sampled. Vectors are whole
multiples of 2^-10, so sums are exact integers, equal in any order. A subset
is cut on a grid of 2^-10 in log2(1 + distance): the last step belongs to it
whole. What is windowed is a histogram, whose length has a bound (distances,
values), never a group's rows; a C-step reads the vectors as numpy matrices of
at most ``CHUNK_ROWS`` documents of a group. After ``FIRST_STEPS`` steps from each
start only the better one goes on. The scatter holds the spread ``FLOOR`` in every
coordinate, as a statistic may be constant, and counts ``PRIOR_ROWS`` rows of
spread ``PRIOR``, so that groups of a few documents have one too.

Defined cases: null text has no words and fails the base rules; null lang or
source is the empty name; equal documents get equal results; an empty table
gives no row; columns other than doc_id, text, lang and source are ignored.
Very long texts are read whole, one at a time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, slices

#: Share of a group's documents in the subset.
SHARE = 0.75
#: Quantile of the chi-square law beyond which a document is rejected.
LEVEL = 0.9999
#: C-steps from each start, and all of them, fewer if no group's subset changes any more.
FIRST_STEPS, STEPS = 2, 12
#: Documents of a group that a matrix holds.
CHUNK_ROWS = 4096
#: Spread that every coordinate has at least, and that of the prior rows.
FLOOR = (0.4, 0.1, 0.25, 0.5, 0.04)
PRIOR = (1.0, 0.1, 0.25, 0.5, 0.04)
PRIOR_ROWS = 10
GRID = 1024
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = len(FLOOR)
GROUP = ["lang", "source"]


def repeated_words(numbers) -> int:
    """Words inside five-word windows that stand twice or more in the text."""
    import numpy as np

    if len(numbers) < 6:
        return 0
    two = np.unique(numbers[:-1] * (numbers.max() + 1) + numbers[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    five = four[:-1] * (numbers.max() + 1) + numbers[4:]
    _, name, n = np.unique(five, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[name] > 1)
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + 5, -1)
    return int(np.count_nonzero(np.cumsum(ends[:-1])))


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    import re

    import numpy as np

    text = text or ""
    data = text.encode()
    words = data.split()  # bytes: at space and the controls 09 to 0D only
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(names)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    import pyarrow as pa

    source = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                found = list(zip(*(text_statistics(t.as_py()) for t in part.column(3))))
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), *[pa.array(c, pa.int64()) for c in found]],
                                      ["doc_id", *GROUP, *BASE])

    return source.mapInArrow(count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in BASE))


def chi_square(x: float, freedom: int) -> float:
    """Distribution function by the series of the incomplete gamma function."""
    a, z = freedom / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= z / (a + k)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0


def chi_square_quantile(level: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < level:
        high *= 2
    for _ in range(100):
        low, high = (low, (low + high) / 2) if chi_square((low + high) / 2, freedom) >= level else ((low + high) / 2, high)
    return high


def _vector() -> list:
    """The coordinates as whole multiples of 1 / GRID."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = [F.log1p(F.col("n_words")), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
             F.log1p(F.col("n_dup_lines")), F.col("n_repeat_words") / n]
    return [F.round(x * GRID).cast("long") for x in parts]


def _middle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., middle): the lower median of the whole number ``value``; a histogram's length has a bound."""
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return counts.where(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min("value").alias("middle"))


def _unfolded(x) -> DataFrame:
    return F.posexplode(x).alias("dim", "value")


def _solved(moments: DataFrame) -> DataFrame:
    """Centre, inverse scatter and log determinant from n, sums and sums of products (one row a group and start)."""

    def solve(frames):
        import numpy as np
        import pandas as pd

        floor, prior = (np.diag(np.square(x)) for x in (FLOOR, PRIOR))
        cut = chi_square_quantile(SHARE, DIMS)
        widen = SHARE / chi_square(cut, DIMS + 2)  # a subset of the nearest rows has too small a scatter
        for f in frames:
            n = f["n"].to_numpy(float)[:, None]
            centre = np.stack(f["sums"].to_list()).astype(float) / n
            products = np.stack(f["products"].to_list()).astype(float).reshape(-1, DIMS, DIMS) / n[:, :, None]
            scatter = (products - centre[:, :, None] * centre[:, None, :]) / GRID**2 * widen
            n = n[:, :, None]
            scatter = (scatter * n + prior * PRIOR_ROWS) / (n + PRIOR_ROWS) + floor
            yield pd.DataFrame({"lang": f["lang"], "source": f["source"], "start": f["start"], "n": f["n"], "centre": list(centre / GRID),
                                "inverse": list(np.linalg.inv(scatter).reshape(-1, DIMS * DIMS)), "logdet": np.linalg.slogdet(scatter)[1]})

    return moments.mapInPandas(solve, "lang string, source string, start int, n long, centre array<double>, inverse array<double>, logdet double")


def _distance(x: str = "x"):
    """Squared Mahalanobis distance of the row's vector from its group's centre."""
    d = [F.col(x)[i] / F.lit(float(GRID)) - F.col("centre")[i] for i in range(DIMS)]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col("x")[i] for i in range(DIMS)]
    sums = [F.sum(v) for v in x]
    products = {(i, j): F.sum(x[i] * x[j]) for i in range(DIMS) for j in range(i, DIMS)}
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"), F.array(
        *[products[min(i, j), max(i, j)] for i in range(DIMS) for j in range(DIMS)]).alias("products"))


def _starts(rows: DataFrame) -> DataFrame:
    """Both deterministic starts as (lang, source, start, n, centre, inverse, logdet)."""
    dim = [*GROUP, "dim"]
    middle = _middle(rows.select(*GROUP, _unfolded("x")), dim)
    middle = middle.groupBy(*GROUP).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "middle"))), lambda s: s["middle"]).alias("middle"))
    centred = rows.join(middle, GROUP).withColumn("off", F.zip_with("x", "middle", lambda a, b: a - b))
    spread = _middle(centred.select(*GROUP, _unfolded(F.transform("off", F.abs))), dim)
    spread = spread.groupBy(*GROUP).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "middle"))), lambda s: s["middle"]).alias("spread"))
    scale = [F.sqrt(F.pow(F.lit(1.4826 / GRID) * F.col("spread")[i], 2) + F.lit(FLOOR[i] ** 2)) for i in range(DIMS)]
    known = middle.join(spread, GROUP)
    diagonal = known.select(
        *GROUP, F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), F.transform("middle", lambda v: v / GRID).alias("centre"),
        F.array(*[1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]).alias("inverse"), F.lit(0.0).alias("logdet"))
    # Directions from the medians, each coordinate by its own deviation, in whole multiples of 1 / GRID.
    near = centred.join(spread, GROUP)
    unit = F.array(*[F.col("off")[i] / GRID / scale[i] for i in range(DIMS)])
    near = near.select(*GROUP, unit.alias("u"), F.array(*scale).alias("scale"), "middle")
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col("u")[i] * F.col("u")[i] for i in range(DIMS)]))
    ways = near.withColumn("length", length).withColumn("x", F.array(*[
        F.when(F.col("length") > 0, F.round(F.col("u")[i] / F.col("length") * F.col("scale")[i] * GRID)).otherwise(0).cast("long") for i in range(DIMS)]))
    signs = _solved(_moments(ways.withColumn("start", F.lit(1)), [*GROUP, "start"]))
    signs = signs.join(middle, GROUP).select(*GROUP, "start", "n", F.transform("middle", lambda v: v / GRID).alias("centre"), "inverse", "logdet")
    return checkpoint(diagonal.unionByName(signs))


def _chunks(rows: DataFrame) -> DataFrame:
    """(lang, source, x): matrices of the vectors of at most CHUNK_ROWS documents of a group."""
    most = CHUNK_ROWS

    def pack(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for (lang, source), part in f.groupby(GROUP, sort=False)["x"]:
                x = np.stack(part.to_list()).astype(np.int64)
                out += [(lang, source, x[at : at + most].tobytes()) for at in range(0, len(x), most)]
            yield pd.DataFrame(out, columns=[*GROUP, "x"])

    return checkpoint(rows.select(*GROUP, "x").mapInPandas(pack, "lang string, source string, x binary"))


def _steps_of(x, centre, inverse):
    """Grid steps of the distances of a matrix of vectors, and the matrix."""
    import numpy as np

    x = np.frombuffer(x, np.int64).reshape(-1, DIMS)
    off = x / GRID - np.asarray(centre)
    distance = np.einsum("ni,ij,nj->n", off, np.asarray(inverse).reshape(DIMS, DIMS), off)
    return np.floor(np.log2(1 + np.maximum(distance, 0)) * GRID).astype(np.int64), x


def _step(chunks: DataFrame, estimate: DataFrame) -> DataFrame:
    """One C-step: the nearest share of each group, and centre and scatter of it."""
    keys = [*GROUP, "start"]
    types = "lang string, source string, start int"

    def histogram(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for lang, source, start, x, centre, inverse in f.itertuples(index=False):
                step, n = np.unique(_steps_of(x, centre, inverse)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "source": source, "start": start, "step": step, "n": n})

    def moments(frames):
        import pandas as pd

        for f in frames:
            out = []
            for lang, source, start, x, centre, inverse, edge in f.itertuples(index=False):
                step, x = _steps_of(x, centre, inverse)
                x = x[step <= edge]
                out.append((lang, source, start, len(x), x.sum(0), (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "n", "sums", "products"])

    near = chunks.join(estimate.select(*keys, "centre", "inverse"), GROUP).select(*keys, "x", "centre", "inverse")
    w = Window.partitionBy(*keys)
    counts = near.mapInPandas(histogram, f"{types}, step long, n long").groupBy(*keys, "step").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    edge = counts.where(F.col("upto") >= F.ceil(F.lit(SHARE) * F.col("all"))).groupBy(*keys).agg(F.min("step").alias("edge"))
    nearer = chunks.join(estimate.select(*keys, "centre", "inverse").join(edge, keys), GROUP).select(*keys, "x", "centre", "inverse", "edge")
    parts = nearer.mapInPandas(moments, f"{types}, n long, sums array<long>, products array<long>")
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums"),
                                     F.array(*[F.sum(F.col("products")[i]) for i in range(DIMS * DIMS)]).alias("products"))
    return checkpoint(_solved(total))


def estimates(rows: DataFrame) -> DataFrame:
    """(lang, source, centre, inverse) of the subset of least determinant; ``rows``: lang, source, x."""
    chunks, now, state = _chunks(rows), _starts(rows), None
    for k in range(1, STEPS + 1):
        now = _step(chunks, now)
        if k == FIRST_STEPS:
            best = F.min_by(F.struct(*now.columns[2:]), F.struct("logdet", "start"))
            now = now.groupBy(*GROUP).agg(best.alias("best")).select(*GROUP, "best.*")
        if k > FIRST_STEPS:
            before, state = state, now.agg(F.sum("n"), F.bit_xor(F.xxhash64(*GROUP, "n", "logdet"))).first()
            if state == before:
                break
    return now.select(*GROUP, "centre", "inverse")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance (squared; null if the base rules fail) and kept."""
    rows = checkpoint(document_statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn("x", F.array(*_vector())))
    found = estimates(rows.where("NOT base_failed").select(*GROUP, "x"))
    cut = chi_square_quantile(LEVEL, DIMS)
    out = rows.join(found, GROUP, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("doc_id", *BASE, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cut)).alias("kept"))
