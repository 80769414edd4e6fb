"""Near-duplicates by SimHash and a binary trie self-join.

The distinct fingerprints form a binary trie. The self-join walks pairs of
nodes of equal depth together, adds up the bits in which their paths differ and
drops a pair as soon as these exceed the budget. The upper pairs are walked as
a DataFrame: a pair whose two subtrees hold more than NODE_ROWS fingerprints is
expanded two levels, so hot prefixes go deeper; the others become tasks, each of
which walks its two subtrees in numpy. A task sends back a spanning forest of
its links (members of a linked set hang on each other in a tree of degree
FAN_OUT), which joins the same components as all its pairs. Copies share one
fingerprint and are one row throughout.

Null and empty texts have no words: fingerprint zero, linked like any other. A
text of fewer words than a shingle is one shingle. Null doc_ids rank last: they
name a component only if it has no other id (then null). Repeated rows are one
group. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, free_name, slices
from cohortflow.llm.components import connected_components

SEED = 42
#: Fingerprints of the two subtrees that one task walks, at most.
NODE_ROWS = 16_384
#: Depth of the first node pairs, and levels of each further step.
FIRST_DEPTH, STEP = 6, 2
FAN_OUT = 8
#: Node pairs that numpy holds at once, and subtree sizes whose pairs are compared outright.
FRONTIER, LEAF_PAIRS = 1 << 17, 16
CHUNK_BYTES = 4 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACE = re.compile(rb"[ \t-\r]")


def word_chunks(data: bytes):
    """Lists of words, a few MB of text at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK_BYTES and (m := _SPACE.search(data, at + CHUNK_BYTES)):
            end = m.start()
        yield data[at:end].split()
        at = end


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint: a bit is set if over half the shingles' XXH64 have it set."""
    from xxhash import xxh64_intdigest

    counts, n, tail = np.zeros((8, 256), np.int64), 0, []
    offsets = np.arange(8, dtype=np.int64) * 256

    def add(shingles: list[bytes]) -> None:
        nonlocal counts, n
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
        at = h.astype("<u8").view(np.uint8).reshape(-1, 8) + offsets
        counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
        n += len(shingles)

    for chunk in word_chunks((text or "").encode().lower()):
        ws = tail + chunk
        if len(ws) >= words:
            add([b" ".join(g) for g in zip(*(ws[k:] for k in range(words)))])
        tail = ws[len(ws) - min(len(ws), words - 1):] if words > 1 else []
    if not n and tail:
        add([b" ".join(tail)])
    ones = (counts @ _BITS).ravel()
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; fp as a signed long of the same bits."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = np.array([simhash(t, words) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- inside a task ------------------------------------------------------------


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _pairs(alo, ahi, blo, bhi):
    """All index pairs of the ranges [alo, ahi) x [blo, bhi), row by row."""
    nb = bhi - blo
    size = (ahi - alo) * nb
    row = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return alo[row] + k // nb[row], blo[row] + k % nb[row]


def trie_pairs(fps: np.ndarray, starts: list[tuple[int, int, int, int]], depth: int, bits: int):
    """Index pairs i < j of the sorted fingerprints ``fps`` that differ in at most
    ``bits`` bits, as arrays, from node pairs [alo, ahi) x [blo, bhi) at ``depth``."""
    first = [np.array(x, np.int64) for x in zip(*starts)]
    stack = [(depth, *first)]
    while stack:
        d, alo, ahi, blo, bhi = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(d, alo[:half], ahi[:half], blo[:half], bhi[:half]), (d, alo[half:], ahi[half:], blo[half:], bhi[half:])]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (d >= 64)
        if small.any():
            i, j = _pairs(alo[small], ahi[small], blo[small], bhi[small])
            keep = (i < j) & (_differing(fps[i], fps[j]) <= bits)
            yield i[keep], j[keep]
        alo, ahi, blo, bhi = (x[~small] for x in (alo, ahi, blo, bhi))
        if not len(alo):
            continue
        bit = np.uint64(1 << (63 - d))
        above = np.uint64((1 << 64) - (1 << (64 - d))) if d else np.uint64(0)
        amid = np.searchsorted(fps, (fps[alo] & above) | bit)
        bmid = np.searchsorted(fps, (fps[blo] & above) | bit)
        same = alo == blo
        out = []
        for a0, a1, b0, b1, ok in ((alo, amid, blo, bmid, True), (amid, ahi, bmid, bhi, True),
                                   (alo, amid, bmid, bhi, True), (amid, ahi, blo, bmid, ~same)):
            out.append([x[(a0 < a1) & (b0 < b1) & ok] for x in (a0, a1, b0, b1)])
        alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*out))
        # Bits in which the paths to depth d + 1 differ, summed from the paths themselves.
        path = np.uint64((1 << 64) - (1 << (63 - d)))
        near = _differing(fps[alo] & path, fps[blo] & path) <= bits
        if near.any():
            stack.append((d + 1, *(x[near] for x in (alo, ahi, blo, bhi))))


class Forest:
    """Union-find over 0..n-1, fed with arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        differ = a != b
        if differ.any():
            for x, y in np.unique(np.stack([a[differ], b[differ]], 1), axis=0).tolist():
                x, y = self.find(x), self.find(y)
                self.root[max(x, y)] = min(x, y)
            self.flatten()

    def flatten(self) -> None:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]


def forest_links(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each set: member k to member (k - 1) // FAN_OUT."""
    order = np.argsort(forest.root, kind="stable")
    root = forest.root[order]
    start = np.flatnonzero(np.r_[True, root[1:] != root[:-1]]) if len(root) else np.zeros(0, int)
    first = np.repeat(start, np.diff(np.r_[start, len(root)]))
    k = np.arange(len(root)) - first
    child = np.flatnonzero(k > 0)
    return order[first[child] + (k[child] - 1) // FAN_OUT], order[child]


# --- over the cluster -----------------------------------------------------------


def _prefix(fp, depth: int):
    return F.shiftrightunsigned(fp, 64 - depth)


def node_pairs(fps: DataFrame, bits: int):
    """Yields (depth, tasks) with tasks (a, b): pairs of trie nodes of that depth, a <= b,
    whose paths differ in at most ``bits`` bits and whose subtrees fit a task."""
    spark, depth, frontier = fps.sparkSession, 0, None
    while depth < 64:
        step = FIRST_DEPTH if depth == 0 else STEP
        steps = [(i, j) for i in range(1 << step) for j in range(1 << step) if (i ^ j).bit_count() <= bits]
        depth += step
        nodes = fps.groupBy(_prefix("fp", depth).alias("node")).count()
        if frontier is None:
            grown = spark.createDataFrame([(i, j, (i ^ j).bit_count()) for i, j in steps if i <= j], "a long, b long, differ int")
        else:
            moves = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit((i ^ j).bit_count()).alias("more"))
                              for i, j in steps])
            grown = (frontier.select("a", "b", "differ", F.inline(moves))
                     .selectExpr(f"shiftleft(a, {step}) + i as a", f"shiftleft(b, {step}) + j as b", "differ + more as differ")
                     .where(f"differ <= {bits} and a <= b"))
        grown = checkpoint(grown.join(nodes.toDF("a", "a_rows"), "a").join(nodes.toDF("b", "b_rows"), "b")
                           .selectExpr("a", "b", "differ", "if(a = b, a_rows, a_rows + b_rows) as n"))
        yield depth, grown.where(f"n <= {NODE_ROWS}").select("a", "b")
        frontier = grown.where(f"n > {NODE_ROWS}").select("a", "b", "differ")
        if frontier.isEmpty():
            return


def _walker(depth: int, bits: int):
    """Walks one pair of nodes: rows (a, b, fp) of both subtrees to links (u, v)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        fp = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        mid = int(np.searchsorted(fp >> np.uint64(64 - depth), np.uint64(b))) if a != b else 0
        start = (0, mid, mid, len(fp)) if a != b else (0, len(fp), 0, len(fp))
        forest = Forest(len(fp))
        for i, j in trie_pairs(fp, [start], depth, bits):
            forest.add(i, j)
        u, v = forest_links(forest)
        return pd.DataFrame({"u": fp[u].view(np.int64), "v": fp[v].view(np.int64)})

    return walk


def links(fps: DataFrame, bits: int) -> DataFrame:
    """(u, v): links that join the distinct fingerprints ``fp`` exactly as all pairs
    within ``bits`` differing bits would."""
    out = None
    for depth, tasks in node_pairs(fps, bits):
        members = tasks.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        rows = members.join(fps.select("fp", _prefix("fp", depth).alias("node")), "node")
        got = rows.select("a", "b", "fp").groupBy("a", "b").applyInPandas(_walker(depth, bits), "u long, v long")
        out = got if out is None else out.union(got)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """Each row's doc_id, text_hash, fingerprint (16 hex digits), root (a fingerprint that
    names its group) and component_id, the smallest doc_id that links reach."""
    rows = checkpoint(fingerprints(docs, words))
    ids = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(connected_components(links(ids.select("fp"), bits)))
    merged = ids.join(roots.toDF("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = merged.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id
    (null ids last), of equal ids that of the smallest text hash; all columns stay."""
    rows = checkpoint(near_duplicates(docs, words, bits))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = rows.groupBy("root").agg(F.min(key).alias("k"))
    ids = kept.select(F.col("k.doc_id").alias("id_"), F.col("k.text_hash").alias("hash_"))
    hash_ = free_name(docs, "text_hash__")
    d = docs.withColumn(hash_, F.xxhash64("text"))
    one = d.join(ids, d["doc_id"].eqNullSafe(ids["id_"]) & (d[hash_] == ids["hash_"]), "left_semi")
    return one.dropDuplicates(["doc_id", hash_]).drop(hash_)
