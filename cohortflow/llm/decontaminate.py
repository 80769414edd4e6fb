"""Benchmark decontamination by winnowing.

Words are hashed, K-grams of words get a hash from these, and of each window of
W = window - K + 1 neighbouring K-grams the least hash is kept as a fingerprint
(the leftmost of equal ones). Equal spans of ``window`` words hold one such
window, so both sides keep a fingerprint of it at the same place: every shared
span is found. Items shorter than ``window`` are found by the hash of all their
words against all the documents' grams of that length. Fingerprints of documents
and items meet in a join, and each meeting is extended word by word to the span
that really is equal, so hash collisions never count. A bitmap of fixed size
(BITMAP_BITS) of the items' fingerprints drops nearly all others before the
shuffle; where it is full the join alone decides, with the same result.

Null and empty texts have no words and no hits. Repeated rows get a row each;
rows are told apart by doc_id and text. Items without words or with a null
text are ignored; an item of null id marks words but is not listed. Empty
tables give no rows or no hits. Extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, free_name, slices

WINDOW, K = 10, 5
BITMAP_BITS = 1 << 22
PIECE_BYTES = 1 << 20

#: Byte classes: 0 for separators, else the byte with A-Z in lower case.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _CLASS[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _CLASS[_b] = _b + 32
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and hashes of the words, a piece of the text at a time."""
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE_BYTES and (m := _SEPARATOR.search(data, at + PIECE_BYTES)):
            end = m.start()
        x = _CLASS[np.frombuffer(data, np.uint8, end - at, at)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (x > 0).view(np.int8), [0]))))
        start, stop = edge[::2], edge[1::2]
        power, inverse = _powers(PIECE_BYTES if len(x) <= PIECE_BYTES else 1 << len(x).bit_length())
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)))
        h = (total[stop] - total[start]) * inverse[start]
        parts.append((start + at, stop + at, _mixed(h + (stop - start).astype(np.uint64))))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b, c = (np.concatenate(p) for p in zip(*parts))
    return a, b, c


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : j + n]
    return _mixed(out)


def winnowed(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash in each window of w grams, without repeats."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        one = g[j : j + n]
        less = one < least
        least = np.where(less, one, least)
        at = np.where(less, np.arange(j, j + n), at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _slots(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(64 - BITMAP_BITS.bit_length() + 1)
    return (g >> bits).astype(np.int64), ((g * np.uint64(_BASE)) >> bits).astype(np.int64)


def span_rows(data: bytes, families, bitmap, window: int, k: int):
    """Word count and fingerprints (pos, gram, hash, left, context) of one text.

    families(n): the gram lengths to take from a text of n words, and whether to take
    every gram or the winnowed ones. The context is the gram with up to window - gram
    words on either side, ``left`` of them before it.
    """
    start, stop, h = hashed_words(data)
    low, n, out = None, len(start), []
    for size, every in families(n):
        g = grams(h, size)
        at = np.arange(len(g)) if every else winnowed(g, window - k + 1)
        if bitmap is not None:
            one, two = _slots(g[at])
            at = at[((bitmap[one >> 3] >> (one & 7)) & (bitmap[two >> 3] >> (two & 7)) & 1).astype(bool)]
        side = window - size
        for p, code in zip(at.tolist(), g[at].view(np.int64).tolist()):
            low = low if low is not None else data.lower()
            a, b = max(0, p - side), min(n, p + size + side)
            words = [low[s:e] for s, e in zip(start[a:b].tolist(), stop[a:b].tolist())]
            out.append((p, size, code, p - a, b" ".join(words).decode()))
    return n, out


_SPANS = "array<struct<pos:long,gram:int,hash:long,left:int,context:string>>"
_ARROW = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int32()), ("hash", pa.int64()), ("left", pa.int32()), ("context", pa.string())]))


def _spans(rows: DataFrame, families, bitmap, window: int, k: int) -> DataFrame:
    """(id, text_hash, n_words, spans) of each row (id, text)."""

    def run(batches):
        bits = np.frombuffer(bitmap, np.uint8) if bitmap is not None else None
        for batch in batches:
            for part in slices(batch):
                got = [span_rows((t or "").encode(), families, bits, window, k) for t in part.column(2).to_pylist()]
                spans = pa.array([[dict(zip(("pos", "gram", "hash", "left", "context"), s)) for s in x] for _, x in got], _ARROW)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([n for n, _ in got], pa.int64()), spans],
                    ["id", "text_hash", "n_words", "spans"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text_hash long, n_words long, spans {_SPANS}")


def _bitmap(items: DataFrame) -> bytes:
    """Two bits for each item fingerprint; BITMAP_BITS / 64 rows reach the driver at most."""

    def run(batches):
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            s = np.unique(np.concatenate(_slots(g)))
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.left_shift(np.int64(1), s & 63))], ["word", "bit"])

    words = np.zeros(BITMAP_BITS // 64, np.int64)
    for at, bits in items.select("hash").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit")).collect():
        words[at] = bits
    return words.astype("<i8").tobytes()


def _extended(window: int):
    """Meetings of equal hash to the equal span around them, if long enough."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "text_hash", "item_id", "pos", "gram", "left", "context", "item_left", "item_context")]
            rows = []
            for doc, code, item, pos, size, left, words, item_left, item_words in zip(*cols):
                x, y = words.split(" "), item_words.split(" ")
                if x[left : left + size] != y[item_left : item_left + size]:
                    continue
                before = 0
                while before < min(left, item_left) and x[left - before - 1] == y[item_left - before - 1]:
                    before += 1
                i, j = left + size, item_left + size
                while i < len(x) and j < len(y) and x[i] == y[j]:
                    i, j = i + 1, j + 1
                if i - left + before >= min(window, len(y)):
                    rows.append((doc, code, item, pos - before, pos - left + i))
            names = ["id", "text_hash", "item_id", "first", "end"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows (id, text_hash, n_words) of all documents, and hits (id,
    text_hash, item_id, first, end), the spans of document words equal to item words."""
    texts = lambda df, key: df.select(F.col(key).alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    items = texts(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), "item_id")
    # A short item is one gram of all its words.
    of_item = lambda n: [(k, False)] if n >= window else [(n, True)] if n else []
    item_rows = checkpoint(_spans(items, of_item, None, window, k).where("n_words > 0"))
    grams_ = item_rows.select("n_words", F.col("id").alias("item_id"), F.inline("spans"))
    short = sorted(r[0] for r in item_rows.where(F.col("n_words") < window).select("n_words").distinct().collect())
    # Short items are sought among all grams of their length; for length k these hold the winnowed ones.
    dense = short if k in short else [*short, k]
    of_doc = lambda n: [(x, x in short) for x in dense if x <= n and (x in short or n >= window)]
    doc_rows = checkpoint(_spans(texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), of_doc, _bitmap(grams_), window, k))
    meet = doc_rows.select("id", "text_hash", F.inline("spans")).join(
        grams_.select("hash", "gram", "item_id", F.col("left").alias("item_left"), F.col("context").alias("item_context")), ["hash", "gram"])
    hits = meet.select("id", "text_hash", "item_id", "pos", "gram", "left", "context", "item_left", "item_context").mapInArrow(
        _extended(window), "id long, text_hash long, item_id string, first long, end long")
    return doc_rows.select("id", "text_hash", "n_words"), hits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """id, text_hash, n_words, n_hit and the sorted ``items`` of each document."""
    rows, hits = contaminated_spans(docs, benchmark, window, k)
    spans = F.array_sort(F.collect_set(F.struct("first", "end")))
    found = hits.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.aggregate(
            spans, F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
            lambda s, x: F.struct(F.greatest(s["reach"], x["end"]).alias("reach"),
                                  (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["reach"], x["first"]))).alias("n")),
            lambda s: s["n"]).alias("n_hit"))
    f = found.toDF("id_", "hash_", "items", "n_hit")
    joined = rows.join(f, rows["id"].eqNullSafe(f["id_"]) & (rows["text_hash"] == f["hash_"]), "left")
    return joined.select("id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay."""
    _, hits = contaminated_spans(docs, benchmark, window, k)
    bad = hits.select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    hash_ = free_name(docs, "text_hash__")
    d = docs.withColumn(hash_, F.xxhash64("text"))
    return d.join(bad, d["doc_id"].eqNullSafe(bad["id_"]) & (d[hash_] == bad["hash_"]), "left_anti").drop(hash_)
