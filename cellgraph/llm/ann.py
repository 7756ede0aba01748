"""Approximate nearest neighbours over stable random projections and kd-trees.

Vectors are projected to ``dimensions`` Gaussian coordinates, in which a squared
distance divided by the true squared distance follows a chi-square law. The
projected space is cut into cells by the splits of a kd-tree fitted on a bounded
sample; every vector is put into its cell, and large cells into blocks. Each
block is a kd-tree of its own, searched in growing projected distance: points
met are verified by their true distance, until a chi-square test says that a
nearer one is improbable among the rest. A query first searches its own cell;
its k-th distance then tells which other cells the test does not rule out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, ship
from .embdup import usable

ship(__name__)


@dataclass(frozen=True)
class Config:
    """sample: vectors that the cells' splits are fitted on at most (about); every vector is indexed.

    certainty: the chi-square test stops a search when a point outside would be
    missed with probability 1 - certainty or less. dimensions must be even.
    """

    k: int = 10
    dimensions: int = 8
    certainty: float = 0.97
    rows_per_cell: int = 8000
    most_cells: int = 1024
    queries_per_block: int = 2000
    leaf: int = 128
    sample: int = 20_000
    seed: int = 41


def chi_square(x, dimensions: int):
    """P(chi-square with an even number of degrees of freedom <= x)."""
    half, term, total = np.asarray(x, np.float64) / 2, 1.0, 1.0
    for i in range(1, dimensions // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class KdTree:
    """Leaves of at most ``leaf`` points with the boxes of all nodes; incremental search by box distance."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.nodes = points, []
        order = np.arange(len(points))
        stack = [(0, len(points), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = points[order[lo:hi]]
            low, high = own.min(0), own.max(0)
            node = len(self.nodes)
            self.nodes.append([low, high, -1, -1, lo, hi])
            if parent >= 0:
                self.nodes[parent][2 + side] = node
            axis = int(np.argmax(high - low))
            if hi - lo > leaf and high[axis] > low[axis]:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
                stack += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.order = order

    def leaves(self, q: np.ndarray):
        """(squared box distance, points) of the leaves, nearest first."""
        heap = [(0.0, 0)]
        while heap:
            d, i = heapq.heappop(heap)
            low, high, left, right, lo, hi = self.nodes[i]
            if left < 0:
                yield d, self.order[lo:hi]
                continue
            for child in (left, right):
                low, high = self.nodes[child][0], self.nodes[child][1]
                gap = np.maximum(low - q, 0) + np.maximum(q - high, 0)
                heapq.heappush(heap, (float(gap @ gap), child))


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, projected: np.ndarray, own: int | None, bound: float, cfg: Config):
    """(distance, id) of the nearest found, as the chi-square test allows; bound: a k-th distance known already."""
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    for d, points in tree.leaves(projected):
        kth = min(bound, best_d[cfg.k - 1] if len(best_d) >= cfg.k else np.inf)
        if kth < np.inf and (kth == 0 and d > 0 or kth > 0 and chi_square(d / kth**2, cfg.dimensions) >= cfg.certainty):
            break
        diff = vectors[points] - q
        dist = np.sqrt((diff * diff).sum(1))
        near = dist <= kth
        if own is not None:
            near &= ids[points] != own
        if near.any():
            best_d, best_i = np.append(best_d, dist[near]), np.append(best_i, ids[points][near])
            order = np.lexsort((best_i, best_d))[: cfg.k]
            best_d, best_i = best_d[order], best_i[order]
    return best_d, best_i


class Cells:
    """The upper kd-tree: split planes fitted on a sample, and the cells' bounds."""

    def __init__(self, sample: np.ndarray, cells: int):
        d = sample.shape[1]
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; below 0: cell
        self.low, self.high = [], []
        self._cut(sample, np.full(d, -np.inf), np.full(d, np.inf), cells)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _cut(self, points, low, high, cells: int) -> int:
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(len(low))
        axis = int(np.argmax(spread))
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        if cells < 2 or spread[axis] == 0 or not (points[:, axis] < value).any():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        at = len(self.splits)
        self.splits.append(None)
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = value
        under = points[:, axis] < value
        a = self._cut(points[under], low, left_high, cells // 2)
        b = self._cut(points[~under], right_low, high, cells - cells // 2)
        self.splits[at] = (axis, value, a, b)
        return at

    def of(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        if not self.splits:
            return out
        stack = [(0, np.arange(len(p)))]
        while stack:
            node, at = stack.pop()
            axis, value, a, b = self.splits[node]
            under = p[at, axis] < value
            for child, rows in ((a, at[under]), (b, at[~under])):
                if child < 0:
                    out[rows] = -child - 1
                elif len(rows):
                    stack.append((child, rows))
        return out

    def gaps(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        g = np.maximum(self.low[None] - p[:, None], 0) + np.maximum(p[:, None] - self.high[None], 0)
        return (g * g).sum(2)


def _matrix(cfg: Config, d: int) -> np.ndarray:
    return np.random.default_rng([cfg.seed, d]).normal(size=(d, cfg.dimensions))


def _project(cfg: Config, dimension: int, cells: Cells | None):
    m = _matrix(cfg, dimension)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dimension)
            p = x @ m
            cell = cells.of(p) if cells else np.zeros(len(p), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(p), pa.list_(pa.float64())), pa.array(cell, pa.int64())], ["id", "v", "p", "cell"])

    return run


def _visits(cfg: Config, cells: Cells, rows_at_once: int = 256):
    """The cells besides its own that the chi-square test does not rule out for a query."""

    def run(batches):
        for batch in (whole.slice(at, rows_at_once) for whole in batches for at in range(0, whole.num_rows, rows_at_once)):
            ids, vs, ps, cell, kth = (batch.column(i) for i in range(5))
            gaps = cells.gaps(np.array(ps.to_pylist(), np.float64).reshape(-1, cfg.dimensions))
            rows, to = [], []
            for i in range(batch.num_rows):
                r = kth[i].as_py()
                near = np.ones(gaps.shape[1], bool) if r is None else gaps[i] == 0 if r == 0 else chi_square(gaps[i] / r**2, cfg.dimensions) < cfg.certainty
                near[cell[i].as_py()] = False
                rows += [i] * int(near.sum())
                to += np.flatnonzero(near).tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), vs.take(at), ps.take(at), pa.array(to, pa.int64()), kth.take(at)], ["id", "v", "p", "cell", "kth"])

    return run


def _searcher(cfg: Config):
    def run(keys, table):
        cols = {c: table.column(c) for c in table.column_names}
        is_q = np.array(cols["q"].to_pylist(), bool)
        v = np.array(cols["v"].to_pylist(), np.float64)
        p = np.array(cols["p"].to_pylist(), np.float64)
        ids = np.array(cols["id"].to_pylist(), np.int64)
        kth = np.array([np.inf if x is None else x for x in cols["kth"].to_pylist()])
        out = [[], [], []]
        rows = ~is_q
        if rows.any():
            tree = KdTree(p[rows], cfg.leaf)
            for i in np.flatnonzero(is_q):
                d, found = search(tree, v[rows], ids[rows], v[i], p[i], int(ids[i]), kth[i], cfg)
                out[0] += [int(ids[i])] * len(d)
                out[1] += found.tolist()
                out[2] += d.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _search_cells(rows: DataFrame, queries: DataFrame, cfg: Config) -> DataFrame:
    """Search every query in the cell that stands beside it; rows and queries meet by (cell, row block, query block)."""
    n = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cfg.rows_per_cell)).cast("int").alias("rb"))
    m = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cfg.queries_per_block)).cast("int").alias("qb"))
    sizes = F.broadcast(materialize(n.join(m, "cell"), "cells"))  # at most most_cells rows
    r = rows.join(sizes, "cell").withColumn("r", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rb")).cast("int"))
    r = r.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("cell", "r", "b", F.lit(False).alias("q"), "id", "v", "p", F.lit(None).cast("double").alias("kth"))
    q = queries.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("id", F.lit(2)), F.col("qb")).cast("int"))
    q = q.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).select("cell", "r", "b", F.lit(True).alias("q"), "id", "v", "p", "kth")
    return r.unionByName(q).groupBy("cell", "r", "b").applyInArrow(_searcher(cfg), "query_id long, vec_id long, score double")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, is_query: F.Column, cfg: Config = Config(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows, by Euclidean distance, of every row for which ``is_query`` holds.

    Returns ``query_id``, ``rank`` (from 1, ties to the smaller id), ``vec_id``
    and ``score`` (the distance, in double precision); fewer rows if there are
    fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids. All vectors must have
    one length; those of another length than the most frequent take no part.
    Rows that repeat an id are candidates each, but never of their own id.
    """
    base = rows.filter(usable(vector_col) & F.col(id_col).isNotNull())
    base = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    d, n = lengths
    base = base.filter(F.size("v") == d)
    share = min(1.0, cfg.sample / n)
    sample = base.filter(F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(1 << 30)) <= share * (1 << 30)).select("v").collect()
    points = np.array([r[0] for r in sample], np.float64).reshape(-1, d) @ _matrix(cfg, d)
    cells = Cells(points, min(cfg.most_cells, max(1, -(-n // cfg.rows_per_cell))))
    schema = "id long, v array<double>, p array<double>, cell long"
    placed = base.select("id", "v").mapInArrow(_project(cfg, d, cells), schema)
    asked = materialize(base.filter("q").select("id", "v").distinct().mapInArrow(_project(cfg, d, cells), schema), "queries")
    first = materialize(_nearest(_search_cells(placed, asked.withColumn("kth", F.lit(None).cast("double")), cfg), cfg.k), "found")
    kth = first.filter(F.col("rank") == cfg.k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = asked.join(kth, "id", "left").select("id", "v", "p", "cell", "kth")
    others = materialize(known.mapInArrow(_visits(cfg, cells), schema + ", kth double"), "visits")
    more = _search_cells(placed, others, cfg)
    out = _nearest(first.select("query_id", "vec_id", "score").union(more).distinct(), cfg.k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_stable_projections(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every embedding whose id is divisible by 100, among all embeddings."""
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
