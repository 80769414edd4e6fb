"""Exact top-k inner products by best-first search in M-trees.

With a coordinate sqrt(M^2 - |x|^2) added (M: the largest norm) all vectors have
norm M, and the largest inner products with a query are its nearest vectors, a
metric search. Vectors go to the nearest of CELLS routing objects at most; a cell
is cut by hash into parts of some TREE_ROWS vectors, and each part becomes an
M-tree: pages of PAGE entries that hold a routing object, its covering radius and
the distance to the parent. A query first searches the cell that may hold its
nearest vectors, which bounds its k-th score; then only the cells that can beat
that score, pruned by radii, inside a tree also by the stored parent distances
before any distance is computed. Scores are integers computed exactly; bounds
carry a slack far above rounding errors.

Equal vectors are one entry with the k + 1 smallest ids, which is all that a
result can show, so copies cost nothing. Vectors that are null or hold null or
non-finite components, and rows of null id, take no part; repeated rows count
once, a query never meets its own id. Shorter vectors count as padded with
zeros. An empty table gives no rows. Extra columns are not read. Scores are 64-bit
integers: a vector whose squared norm in whole units passes 2^62 raises an error.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint

#: Routing objects at most (they are sent to every task, so their number is bounded).
CELLS = 1024
#: Vectors of a tree: total / 64 within these limits. Entries of a page. Queries of a block.
TREE_ROWS, PAGE, BLOCK = (512, 8192), 32, 4096
SLACK = 1e-6
_LAST = -(1 << 62)


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, norm2, dims): v holds floor(scale * x) of each component as int64 bytes."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not x.is_valid:
                    continue
                if x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all():
                    units = np.floor(x * scale)
                    if float(units @ units) > 2.0**62:  # so that no inner product can pass 64 bits
                        raise ValueError(f"vector {i} is too large for exact 64-bit scores")
                    ids.append(i)
                    out.append(units.astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in out], pa.binary()),
                 pa.array([float(v @ v) for v in out], pa.float64()), pa.array([len(v) for v in out], pa.int32())],
                ["vec_id", "v", "norm2", "dims"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, v binary, norm2 double, dims int")


def matrix(values, dims: int) -> np.ndarray:
    """int64 matrix of packed vectors, padded with zeros."""
    values = list(values)
    if all(len(v) == 8 * dims for v in values):
        return np.frombuffer(b"".join(values), "<i8").reshape(len(values), dims)
    out = np.zeros((len(values), dims), np.int64)
    for row, v in zip(out, values):
        row[: len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors with the coordinate that gives all the norm sqrt(top)."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


class Tree:
    """A paged M-tree over lifted vectors. Page p has a routing object ``router``
    (index of a vector; the root has the cell's routing object instead), a covering
    ``radius``, the distance ``up`` to its parent's routing object, and either child
    pages or entries ``order[first:last]`` with their distances ``far`` to the router."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], router: np.ndarray, top: float, page: int = PAGE) -> None:
        self.vectors, self.ids, self.top = vectors, ids, top
        x = lifted(vectors, top)
        self.pages: list[tuple] = []
        self.order, self.far = [], []
        self._grow(x, np.arange(len(x)), router, -1, 0.0, page)
        self.order, self.far = np.array(self.order, np.int64), np.array(self.far)

    def _grow(self, x, members, router, at, up, page) -> int:
        d = distances(x[members], router[None])[:, 0]
        me = len(self.pages)
        self.pages.append(())
        if len(members) <= page:
            first = len(self.order)
            self.order += members.tolist()
            self.far += d.tolist()
            self.pages[me] = (at, float(d.max(initial=0)), up, None, first, len(self.order))
            return me
        fan = min(page, -(-len(members) // page))
        picked = members[np.linspace(0, len(members) - 1, fan).astype(int)]
        near = distances(x[members], x[picked]).argmin(1)
        parts = [members[near == k] for k in range(fan)]
        if max(map(len, parts)) > 0.9 * len(members):  # too alike to part by distance: cut evenly by it
            parts = np.array_split(members[np.argsort(d, kind="stable")], max(2, fan))
            picked = np.array([p[0] for p in parts])
        children = []
        for obj, part in zip(picked, parts):
            if len(part):
                children.append(self._grow(x, part, x[obj], int(obj), float(distances(x[obj][None], router[None])[0, 0]), page))
        self.pages[me] = (at, float(d.max()), up, np.array(children), 0, 0)
        return me

    def search(self, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]], to_root: float) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, -vec_id) of ``best`` and this tree, and the distances computed."""
        q2, computed = float(q @ q), 0
        slack = SLACK * (np.sqrt(self.top) + np.sqrt(q2) + 1)
        cut = np.inf if len(best) < k else np.sqrt(max(0.0, q2 + self.top - 2 * best[-1][0])) + slack
        queue = [(max(0.0, to_root - self.pages[0][1]), 0, to_root)]
        while queue:
            bound, p, to = heapq.heappop(queue)
            if bound > cut:
                break
            _, _, _, children, first, last = self.pages[p]
            if children is not None:
                radius = np.array([self.pages[c][1] for c in children])
                up = np.array([self.pages[c][2] for c in children])
                children = children[np.abs(to - up) - radius <= cut]  # by parent distances alone
                if not len(children):
                    continue
                router = np.array([self.pages[c][0] for c in children])
                d = np.sqrt(np.maximum(q2 + self.top - 2.0 * (self.vectors[router] @ q), 0))
                computed += len(children)
                for c, dist in zip(children.tolist(), d.tolist()):
                    low = max(0.0, dist - self.pages[c][1])
                    if low <= cut:
                        heapq.heappush(queue, (low, c, dist))
                continue
            entries = self.order[first:last]
            entries = entries[np.abs(to - self.far[first:last]) <= cut]
            if not len(entries):
                continue
            score = self.vectors[entries] @ q
            computed += len(entries)
            if len(best) >= k:
                ok = score >= best[-1][0]
                entries, score = entries[ok], score[ok]
            new = [(s, -i) for e, s in zip(entries.tolist(), score.tolist()) for i in self.ids[e] if i != query_id]
            if new:
                best = sorted(best + new, reverse=True)[:k]
                if len(best) == k:
                    cut = np.sqrt(max(0.0, q2 + self.top - 2 * best[-1][0])) + slack
        return best, computed


def _directory(rows: DataFrame, cells: int, dims: int) -> np.ndarray:
    """Routing objects: the ``cells`` vectors of least hash."""
    hashed = rows.select("v", F.xxhash64("v").alias("h"))
    least = [r.h for r in hashed.select("h").orderBy("h").limit(cells).collect()]  # of distinct vectors
    got = hashed.where(F.col("h").isin(least)).orderBy("h", "v").limit(cells).collect()
    return matrix([bytes(r.v) for r in got], dims)


def _nearest_cell(routers: np.ndarray, top: float, dims: int):
    """Rows (v, ids) to (cell, v, ids, to_router)."""
    lifted_routers = lifted(routers, top)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = distances(lifted(matrix(b.column("v").to_pylist(), dims), top), lifted_routers)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("v"), b.column("ids"), pa.array(d[np.arange(len(cell)), cell])],
                                             ["cell", "v", "ids", "to_router"])
    return run


def _built(routers: np.ndarray, top: float, dims: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        cell = int(pdf["cell"].iloc[0])
        tree = Tree(matrix(pdf["v"], dims), [list(map(int, x)) for x in pdf["ids"]], lifted(routers[cell : cell + 1], top)[0], top)
        return pd.DataFrame({"cell": [cell], "part": [int(pdf["part"].iloc[0])], "tree": [pickle.dumps(tree)]})
    return build


def _visits(routers: np.ndarray, radius: np.ndarray, top: float, dims: int, first: bool):
    """Queries to (query_id, v, best, cell, to_router): the cell of least distance bound,
    or the other cells that may beat the query's k-th score."""
    def run(batches):
        for b in batches:
            ids, values, best = (b.column(c).to_pylist() for c in ("query_id", "v", "best"))
            if not ids:
                continue
            q = matrix(values, dims).astype(float)
            q2 = (q * q).sum(1)
            d = np.sqrt(np.maximum(q2[:, None] + top - 2 * q @ routers.T.astype(float), 0))
            low = np.where(np.isfinite(radius), np.maximum(0, d - radius), np.inf)
            home = np.lexsort((d, low), axis=1)[:, 0]
            if first:
                pairs = list(enumerate(home.tolist()))
            else:
                cut = np.array([np.inf if t is None else t for t in best], float)
                cut = np.where(np.isinf(cut), np.inf, np.sqrt(np.maximum(0, q2 + top - 2 * np.where(np.isinf(cut), 0, cut))))
                go = (low <= (cut + SLACK * (np.sqrt(top) + np.sqrt(q2) + 1))[:, None]) & np.isfinite(low)
                go[np.arange(len(home)), home] = False
                pairs = np.argwhere(go).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([values[i] for i, _ in pairs], pa.binary()),
                 pa.array([best[i] for i, _ in pairs], pa.int64()), pa.array([c for _, c in pairs], pa.int32()),
                 pa.array([d[i, c] for i, c in pairs], pa.float64())],
                ["query_id", "v", "best", "cell", "to_router"])
    return run


def _searched(k: int, dims: int):
    def search(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(trees):
            tree = pickle.loads(trees["tree"].iloc[0])
            q = matrix(queries["v"], dims)
            for i, x, floor, to in zip(queries["query_id"].tolist(), q, queries["best"], queries["to_router"].tolist()):
                # A known k-th score stands for k results that lose against any other of that score.
                known = [] if pd.isna(floor) else [(int(floor), _LAST)] * k
                best, _ = tree.search(i, x, k, known, to)
                out += [(i, -n, s) for s, n in best if n != _LAST]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return search


class Index:
    """M-trees over all vectors of ``rows`` (vec_id, embedding)."""

    def __init__(self, rows: DataFrame, k: int = 10, scale: int = 1024) -> None:
        self.k = k
        self.rows = checkpoint(integer_vectors(rows, scale))
        copies = Window.partitionBy("v").orderBy("vec_id")
        first = self.rows.select("vec_id", "v").distinct().withColumn("n_", F.row_number().over(copies)).where(F.col("n_") <= k + 1)
        entries = checkpoint(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
        self.top, self.dims = self.rows.agg(F.max("norm2"), F.max("dims")).first()
        n = entries.count()
        if not n:
            self.trees = None
            return
        size = min(TREE_ROWS[1], max(TREE_ROWS[0], n // 64))
        self.routers = _directory(entries, min(CELLS, -(-n // size)), self.dims)
        placed = checkpoint(entries.mapInArrow(_nearest_cell(self.routers, self.top, self.dims), "cell int, v binary, ids array<long>, to_router double"))
        spark = rows.sparkSession
        cells = placed.groupBy("cell").agg(F.count("*"), F.max("to_router")).collect()
        self.radius = np.full(len(self.routers), np.inf)
        for cell, _, far in cells:
            self.radius[cell] = far
        parts = spark.createDataFrame([(c, -(-m // size)) for c, m, _ in cells], "cell int, parts int")
        cut = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
        self.parts = parts.select("cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
        self.trees = checkpoint(cut.select("cell", "part", "v", "ids").groupBy("cell", "part").applyInPandas(
            _built(self.routers, self.top, self.dims), "cell int, part int, tree binary"))

    def _round(self, queries: DataFrame, blocks: int, first: bool) -> DataFrame:
        visits = queries.mapInArrow(_visits(self.routers, self.radius, self.top, self.dims, first),
                                    "query_id long, v binary, best long, cell int, to_router double")
        visits = checkpoint(visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
        # A tree goes only to the blocks of which some query visits its cell.
        wanted = visits.select("cell", "block").distinct().withColumnRenamed("block", "wanted")
        trees = self.trees.join(wanted, "cell").withColumnRenamed("wanted", "block")
        visits = visits.join(self.parts, "cell")
        key = ["cell", "part", "block"]
        return visits.groupBy(*key).cogroup(trees.groupBy(*key)).applyInPandas(
            _searched(self.k, self.dims), "query_id long, vec_id long, score long")

    def _best(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def search(self, is_query: Column) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of which ``is_query`` (over vec_id) holds."""
        queries = self.rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
        if self.trees is None:
            return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
        queries = checkpoint(queries.withColumn("best", F.lit(None).cast("long")))
        blocks = -(-queries.count() // BLOCK) or 1
        near = checkpoint(self._best(self._round(queries, blocks, True)))
        kth = near.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("kth"))
        known = checkpoint(queries.drop("best").join(kth, "query_id", "left").select("query_id", "v", F.col("kth").alias("best")))
        rest = self._round(known, blocks, False)
        return self._best(near.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    return Index(rows, k, scale).search(is_query)
