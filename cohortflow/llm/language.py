"""Language identification by error-correcting output codes.

Each learned language gets a codeword; for each bit a binary n-gram classifier
tells the languages of that bit's two sides apart (log odds of hashed byte 1-
to 3-grams of the lower-cased text, from counts over all learning documents,
each document weighing the same). Margins are scaled so that the nearest
languages of the two sides lie at -1 and 1. Decoding adds up, for each codeword,
the logistic loss of every bit's margin, weighted by how far the bit's classifier
separates its sides, and takes the codeword of least loss; the score is the
softmax of the losses, and a document is ambiguous if the two least losses
differ by less than AMBIGUOUS.

Null texts and texts without a letter are `und` with score 0. Rows of null
language teach nothing. With one learned language that one is predicted, with
none `und`. Ties go to the language that sorts first. Whole texts are read, a
piece at a time. Repeated rows are predicted each. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import slices

BITS = 13  # hashed n-grams: 2 ** BITS counters
UNITS = 1_000_000  # a document's weight, in whole units so that sums are exact
AMBIGUOUS = 0.05
PIECE = 1 << 20


def has_letter(text: str) -> bool:
    """A letter in the sense of Unicode; numbers such as ½ or ² are none."""
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 1- to 3-grams of the lower-cased text."""
    counts = np.zeros(1 << BITS, np.int64)
    data = text.lower().encode()
    for at in range(0, len(data), PIECE):
        x = np.frombuffer(data[max(0, at - 2) : at + PIECE], np.uint8).astype(np.uint32)
        new = 0 if at == 0 else 2
        for n in (1, 2, 3):
            h = np.full(max(0, len(x) - n + 1), n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + x[j : j + len(h)]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            # grams that end before the new bytes were counted with the piece before
            counts += np.bincount(h[max(0, new - n + 1) :], minlength=1 << BITS)
    return counts


def codewords(classes: int, seed: int = 0) -> np.ndarray:
    """One row of +-1 for each class: all splits up to five classes, else the best of
    some seeded random codes by least row distance; no column is constant."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        return np.array([np.where(splits >> (c - 1) & 1, 1.0, -1.0) if c else -np.ones(len(splits)) for c in range(classes)])
    rng, length = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(classes)))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (classes, length))
        constant = np.abs(code.sum(0)) == classes
        code[0, constant] *= -1
        apart = (length - code @ code.T) / 2 + length * np.eye(classes)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray  # grams x bits
    middle: np.ndarray
    half: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0, True
        counts = gram_counts(text)
        margin = (counts / counts.sum() @ self.weight - self.middle) / self.half
        loss = np.logaddexp(0, -2 * self.code * margin) @ self.trust
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        p /= p.sum()
        k = int(loss.argmin())
        order = np.sort(loss)
        return self.languages[k], round(float(p[k]), 6), bool(len(order) > 1 and order[1] - order[0] < AMBIGUOUS)


def gram_table(docs: DataFrame, learn: Column) -> DataFrame:
    """(lang, gram, units) over the documents of ``learn`` with a language; partial sums leave each task."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if has_letter(text):
                        c = gram_counts(text)
                        c = c * UNITS // c.sum()
                        total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c[k])], ["lang", "gram", "units"])

    return rows.mapInArrow(run, "lang string, gram long, units long").groupBy("lang", "gram").agg(F.sum("units").alias("units"))


def train(docs: DataFrame, learn: Column) -> Model:
    """Model from all learning documents; languages x 2 ** BITS sums reach the driver at most."""
    rows = gram_table(docs, learn).collect()
    languages = sorted({r.lang for r in rows})
    share = np.zeros((len(languages), 1 << BITS))
    for lang, gram, units in rows:
        share[languages.index(lang), gram] = units
    if not languages:
        return Model([], codewords(0), *[np.zeros(0)] * 4)
    share /= share.sum(1, keepdims=True)
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1), np.ones(1))
    weight, smooth = np.zeros((1 << BITS, code.shape[1])), 1e-6
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weight[:, b] = np.log((one + smooth) / (other + smooth))
    means = share @ weight
    low = np.array([means[code[:, b] > 0, b].min() for b in range(code.shape[1])])
    high = np.array([means[code[:, b] < 0, b].max() for b in range(code.shape[1])])
    gap = np.maximum(low - high, 1e-3)
    trust = gap / (gap + means.std(0))
    return Model(languages, code, weight, (low + high) / 2, gap / 2, trust / trust.sum())


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [model.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_())))],
                    ["id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).mapInArrow(
        run, "id long, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, learn: Column) -> DataFrame:
    """``docs`` without those that are `und` or ambiguous; all columns stay."""
    model = train(docs, learn)

    @F.pandas_udf("boolean")
    def known(text):
        import pandas as pd
        return pd.Series([not model.predict(t)[2] for t in text], dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
