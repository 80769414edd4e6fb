"""Quality classifier by positive-unlabelled learning.

A linear model on features of the whole text is fitted by minimising the
non-negative unbiased risk with logistic loss

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])

over all trusted positives and all unlabelled documents; l(z) - l(-z) = -z makes
the inner sum convex, so Newton steps apply while the maximum is positive and an
ascent step on the negative part otherwise. The class prior is estimated from
all labelled learning rows (share of label 1). Each step is one aggregation over
the written feature table, so every row counts and only sums (a few thousand
numbers) reach the driver.

Null and empty texts have the features of an empty text and are scored like any
other; very long texts are read whole, one at a time, by the same features. Equal
texts have equal scores. Null ids match no label; of repeated labels of an id the largest counts.
Without positives or without documents the score is 0.5. Repeated rows are
scored each. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, slices

STEPS = 15
#: Ridge penalty of a standardised weight: RIDGE + RIDGE_ROWS / positives.
RIDGE, RIDGE_ROWS = 1e-3, 10.0

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B], _LOWER[0x61:0x7B], _DIGIT[0x30:0x3A] = True, True, True
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOLS = [bytes([c])[0] for c in b"!#$%&*+/;:<=>?@[]^_{}|~\"'()-.,\\`"]


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte classes and marks, length, word shape and repetition."""
    data = (text or "").encode()
    n = max(1, len(data))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float) / n
    shares = [hist[_UPPER].sum(), hist[_DIGIT].sum(), hist[_SPACE].sum(), hist[10], hist[128:].sum(),
              hist[_SYMBOLS].sum(), *hist[_SYMBOLS]]
    words = data.split()
    m = max(1, len(words))
    distinct, repeats = len(set(words)), sum(map(bytes.__eq__, words, islice(words, 1, None)))
    lines = data.split(b"\n")
    size = [np.log1p(len(data)) / 10, np.log1p(m) / 10, np.log1p(len(lines)) / 10]
    shape = [min(1.0, n / m / 20), distinct / m, repeats / m, len(set(lines)) / len(lines), hist.max()]
    small = np.array([*shares, *shape])
    return np.concatenate([small, np.sqrt(small), size, np.square(size)]).astype(np.float32)


FEATURES = len(text_features(""))


def feature_column(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` (cast to long) and the features of column text, as packed float32."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text_"))
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = pa.array([text_features(t).tobytes() for t in part.column(len(names)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], x], [*names, "x"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "x binary"]))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)


def _sums(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the vector of(x, positive, unlabelled) of each batch."""

    def run(batches):
        total = None
        for b in batches:
            got = of(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    got = rows.select("x", "positive", "unlabelled").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect()
    out = np.zeros(max((r[0] for r in got), default=-1) + 1)
    for k, v in got:
        out[k] = v
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, to six digits (sums of doubles may differ in the last ones)."""
        z = np.clip(((x - self.mean) / self.scale) @ self.weight[1:] + self.weight[0], -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 6)


def _design(x, mean, scale):
    return np.column_stack([np.ones(len(x)), (x - mean) / scale])


def _step_sums(mean, scale, w):
    def of(x, p, u):
        d = _design(x, mean, scale)
        z = np.clip(d @ w, -30, 30)
        s = 1 / (1 + np.exp(-z))
        loss = np.logaddexp(0, z)
        hess = (d * (u * s * (1 - s))[:, None]).T @ d
        return np.concatenate([[p @ loss, u @ loss], d.T @ p, d.T @ (p * s), d.T @ (u * s), hess.ravel()])
    return of


def fit(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float | None = None) -> Model:
    """Minimises the risk over ``rows`` (x, positive double, unlabelled double)."""
    def moments(x, p, u):
        return np.concatenate([[p.sum(), u.sum()], u @ x, u @ np.square(x)])

    s = _sums(rows, moments)
    if not len(s) or not s[0] or not s[1]:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), prior)
    n_p, n_u = s[0], s[1]
    mean = s[2 : 2 + FEATURES] / n_u
    scale = np.sqrt(np.maximum(s[2 + FEATURES :] / n_u - mean**2, 1e-8))
    d = FEATURES + 1
    w = np.zeros(d)
    w[0] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    keep = np.full(d, RIDGE + RIDGE_ROWS / n_p if ridge is None else ridge)
    keep[0] = 0
    best, move, factor = None, None, 1.0
    for _ in range(steps):
        t = _sums(rows, _step_sums(mean, scale, w))
        p_neg, u_neg = t[0] / n_p, t[1] / n_u
        p_x, p_sx, u_sx = t[2 : 2 + d] / n_p, t[2 + d : 2 + 2 * d] / n_p, t[2 + 2 * d : 2 + 3 * d] / n_u
        negative = u_neg - prior * p_neg
        risk = prior * (p_neg - p_x @ w) + max(0.0, negative) + 0.5 * (keep * w) @ w
        if best is not None and risk > best[0] + 1e-9 and factor > 0.1:
            factor /= 2  # too far: half the way
            w = best[1] + factor * move
            continue
        if best is not None and best[0] - risk < 1e-7 and negative >= 0:
            best = (risk, w)
            break
        best, factor = (risk, w), 1.0
        if negative >= 0:
            grad = u_sx - prior * p_x + keep * w
            hess = t[2 + 3 * d :].reshape(d, d) / n_u + np.diag(keep + 1e-6)
            move = -np.linalg.solve(hess, grad)
        else:  # the model over-fits the positives: raise the negative part again
            move = u_sx - prior * p_sx
        w = w + move
    return Model(mean, scale, best[1], prior)


def labelled(rows: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``rows`` (id, x) with positive and unlabelled weights; ``learn`` over id and doc_id says whose label may be used."""
    known = (labels.select(F.col("doc_id").cast("long").alias("label_id_"), "quality").where(learn)
             .groupBy("label_id_").agg(F.max("quality").alias("quality_")))
    return rows.join(known, rows["id"] == known["label_id_"], "left").select(
        "id", "x", "quality_",
        F.when(F.col("quality_") == 1, 1.0).otherwise(0.0).alias("positive"))


def train(rows: DataFrame, labels: DataFrame, learn_label: Column, learn_row: Column) -> Model:
    """Model from feature rows (id, x): positives are rows labelled 1 among ``learn_label``
    (over doc_id), the unlabelled sample is every row of ``learn_row`` (over id)."""
    known = checkpoint(labelled(rows, labels.where(learn_label), F.lit(True))
                       .withColumn("unlabelled", F.when(learn_row, 1.0).otherwise(0.0)))
    share = known.agg(F.avg("quality_")).first()[0]
    return fit(known, 0.5 if share is None else min(max(share, 0.01), 0.99))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(id, score) of feature rows."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, "id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn_label: Column, learn_row: Column) -> DataFrame:
    """(id, score) of every document."""
    rows = checkpoint(feature_column(docs, [F.col("doc_id").cast("long").alias("id")]))
    return scored(rows, train(rows, labels, learn_label, learn_row))


def keep_good(docs: DataFrame, labels: DataFrame, learn_label: Column, learn_row: Column) -> DataFrame:
    """``docs`` without those that score below 0.5; all columns stay."""
    rows = checkpoint(feature_column(docs, [F.col("doc_id").cast("long").alias("id")]))
    model = train(rows, labels, learn_label, learn_row)

    @F.pandas_udf("boolean")
    def good(text):
        x = np.stack([text_features(t) for t in text]).astype(float) if len(text) else np.zeros((0, FEATURES))
        import pandas as pd
        return pd.Series(model.score(x) >= 0.5)

    return docs.where(good(F.col("text").cast("string")))
