"""Approximate nearest neighbours by few stable projections.

Gaussian (2-stable) projections take each vector to a few coordinates, which a
kd-tree indexes: its top deals all rows into cells, and each cell has a tree of its own.
Projected neighbours come nearest first and are verified with the
true distance. For a row at distance r, (projected distance / r)^2 follows a
chi-square law with as many degrees of freedom as there are projections, so the
search stops once a row nearer than the k-th found would have shown up with the
wanted probability.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import blocks
from plumbline.llm.blocks import dense, queries_of, ranked, usable, visit
from plumbline.llm.common import table, written

PROJECTIONS = 8
CONFIDENCE = 0.985
LEAF = 96
SAMPLE = 65_536


def chi_square_cdf(x: float, freedom: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    term, total = 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total if x < 700 else 1.0


def stop_ratio(freedom: int, confidence: float) -> float:
    """The squared ratio at which the stopping test holds."""
    low, high = 0.0, 1_000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, freedom) < confidence else (low, mid)
    return high


class KdTree:
    """Median splits on the widest coordinate; nodes keep their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.sons: list[tuple[int, int] | None] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            me = len(self.span)
            self.span.append((a, b))
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.sons.append(None)
            if parent >= 0:
                held = self.sons[parent] or (0, 0)
                self.sons[parent] = (me, held[1]) if side == 0 else (held[0], me)
            spread = self.high[me] - self.low[me]
            if b - a > leaf and spread.max() > 0:
                axis, mid = int(spread.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]

    def gap(self, node: int, point: np.ndarray) -> float:
        away = np.maximum(self.low[node] - point, 0) + np.maximum(point - self.high[node], 0)
        return float(away @ away)

    def nearest_leaves(self, point: np.ndarray):
        """(squared lower bound, rows) of the leaves, nearest first; no row that is still to come is nearer than the bound."""
        heap = [(self.gap(0, point), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            sons = self.sons[node]
            if sons is None:
                a, b = self.span[node]
                yield bound, self.order[a:b]
            else:
                for son in sons:
                    heapq.heappush(heap, (self.gap(son, point), son))


class Cells:
    """Median splits of a sample of projected rows: the top of the tree, whose leaves are blocks of rows."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.axis, self.at, self.sons = [], [], []  # of inner nodes; a son below 0 is cell -1 - son
        self.cells = 0
        self.root = self._split(sample, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if cells <= 1 or spread.max() <= 0:
            self.cells += 1
            return -self.cells
        axis = int(spread.argmax())
        at = float(np.median(points[:, axis]))
        if at >= points[:, axis].max():  # a median that most rows share
            at = float(points[points[:, axis] < at, axis].max())
        me = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.sons.append((0, 0))
        low = points[:, axis] <= at
        self.sons[me] = (self._split(points[low], cells // 2), self._split(points[~low], cells - cells // 2))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                low = points[rows, self.axis[node]] <= self.at[node]
                todo += [(self.sons[node][0], rows[low]), (self.sons[node][1], rows[~low])]
        return out


class Neighbours:
    """The rows of a block, their kd-tree, and the search among them for the queries that come by."""

    def __init__(self, ids, qs, bars, vectors, stable: np.ndarray, k: int, ratio: float) -> None:
        self.ids, self.vectors, self.stable, self.k, self.ratio = ids, vectors, stable, k, ratio
        self.tree = KdTree(vectors @ stable)

    def feed(self, ids, qs, bars, vectors) -> pa.RecordBatch:
        """``bars`` are the distances of what the queries have found elsewhere; nothing beyond them counts."""
        out: list[tuple] = []
        for q, key, bar, vector, point in zip(ids.tolist(), qs.tolist(), bars.tolist(), vectors, vectors @ self.stable, strict=True):
            best_d, best_v = np.empty(0), np.empty(0, np.int64)
            for bound, rows in self.tree.nearest_leaves(point):
                reach = min(bar, best_d[-1]) if len(best_d) == self.k else bar
                if bound > self.ratio * reach**2:
                    break
                rows = rows[self.ids[rows] != q]
                d = np.concatenate([best_d, np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))])
                v = np.concatenate([best_v, self.ids[rows]])
                keep = np.lexsort((v, d))[: self.k]
                best_d, best_v = d[keep], v[keep]
            out.append((np.full(len(best_d), q), np.full(len(best_d), key), best_v, best_d))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "q", "vec_id", "score"])

    def finish(self) -> None:
        return None


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance.

    Every row is indexed. The top of the tree is fitted on SAMPLE rows at most, taken by hash;
    each of its cells is a block of rows with a tree of its own. A query visits its own cell, and
    then the cells whose boxes the stopping test does not rule out. Candidates are all rows but
    those with the query's own id; ties go to the smaller id. Null, empty, zero and non-finite
    vectors and null ids take no part; shorter vectors count as padded with zeros. Rows that repeat
    an id all count as candidates; queries that repeat an id have an answer each, but those equal
    in the vector too have one. An empty table gives no rows. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col, zero_ok=False)
    sizes_ = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not sizes_.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, cells = sizes_.d, max(1, min(blocks.BLOCKS, -(-sizes_.n // blocks.BLOCK_ROWS)))
    stable, ratio = np.random.default_rng(seed).standard_normal((width, PROJECTIONS)), stop_ratio(PROJECTIONS, confidence)
    share = min(1 << 20, -(-2 * SAMPLE * (1 << 20) // sizes_.n))
    taken = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share).select("embedding").limit(SAMPLE) if cells > 1 else None
    sample = dense(pa.array([r.embedding for r in taken.collect()], pa.list_(pa.float64())), width) @ stable if taken is not None else np.zeros((0, PROJECTIONS))
    top = Cells(sample, cells)

    def by_cell(batches):
        for batch in batches:
            points = dense(batch.column(1), width) @ stable
            yield pa.RecordBatch.from_arrays([pa.array(top.of(points).astype(np.int32)), *batch.columns, pa.array(list(points), pa.list_(pa.float64()))], ["b", *batch.schema.names, "point"])

    dealt = written(rows.mapInArrow(by_cell, "b int, vec_id long, embedding array<double>, point array<double>"), "vector-cells")
    sizes, low, high = np.zeros(top.cells, np.int64), np.zeros((top.cells, PROJECTIONS)), np.zeros((top.cells, PROJECTIONS))
    ends = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTIONS)]
    for r in dealt.groupBy("b").agg(F.count("*").alias("n"), *ends).collect():
        sizes[r.b] = r.n
        low[r.b], high[r.b] = ([r[f"{name}{i}"] for i in range(PROJECTIONS)] for name in ("low", "high"))
    state = lambda ids, qs, bars, vectors: Neighbours(ids, qs, bars, vectors, stable, k, ratio)
    schema = "query_id long, q long, vec_id long, score double"
    none = F.lit(float("inf"))
    asked = written(queries_of(dealt, is_query).join(dealt.select("b", F.xxhash64("vec_id", "embedding").alias("q"), "vec_id").where(is_query).distinct(), ["vec_id", "q"]), "vector-queries")
    found = written(visit(dealt, asked.select("b", "vec_id", "q", none.alias("bar"), "embedding"), sizes, True, state, schema, width), "vector-first")
    if top.cells > 1:
        best = ranked(found, F.col("score").asc(), k).groupBy("query_id", "q").agg(F.max("score").alias("bar"), F.count("*").alias("n"))
        best = best.select(F.col("query_id").alias("vec_id"), "q", F.when(F.col("n") == k, F.col("bar")).alias("bar"))
        more = asked.join(best, ["vec_id", "q"], "left").select("b", "vec_id", "q", F.coalesce("bar", none).alias("bar"), "embedding")

        def reached(batches):
            for batch in batches:
                home, bar, points = np.asarray(batch.column(0)), np.asarray(batch.column(3)), dense(batch.column(4), width) @ stable
                for i in range(len(home)):
                    away = np.maximum(low - points[i], 0) + np.maximum(points[i] - high, 0)
                    b = np.flatnonzero(((away**2).sum(1) <= ratio * bar[i] ** 2) & (sizes > 0) & (np.arange(top.cells) != home[i]))
                    if len(b):
                        some = batch.take(pa.array(np.full(len(b), i)))
                        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), *some.columns[1:]], batch.schema.names)

        later = written(more.mapInArrow(reached, "b int, vec_id long, q long, bar double, embedding array<double>"), "vector-visits")
        found = found.unionAll(visit(dealt, later, sizes, True, state, schema, width))
    return ranked(found, F.col("score").asc(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
