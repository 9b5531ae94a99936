"""Exact top-k search by inner product.

Vectors go by descending length: blocks of lengths, and rows by length within a block. A
query visits the block of the longest, and after it only those whose length bound
(Cauchy-Schwarz) reaches its k-th best score. A rotation onto the principal axes of all rows
puts most of an inner product into its first coordinates; the rest is bounded by the product
of the residual lengths. Whatever the bounds leave is scored exactly in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import blocks
from plumbline.llm.blocks import dense, queries_of, ranked, usable, visit
from plumbline.llm.common import table, written

SCALE = 256
STEP = 2_048
QUANTILES = 4_096


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, from a sum of products of matrices: width^2 numbers reach the driver."""

    def outer(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = dense(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select("embedding").mapInArrow(outer, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    gram = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r.i, r.j] = r.v
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class Scores:
    """The k best of the rows that come by, for each of the queries that are held; scores are exact integers."""

    def __init__(self, ids, qs, bars, vectors, axes: np.ndarray, k: int) -> None:
        self.ids, self.qs, self.k, self.axes = ids, qs, k, axes
        self.head = max(1, axes.shape[0] // 4)
        self.whole = vectors
        self.length = np.sqrt((vectors**2).sum(1))
        rotated = vectors @ axes
        self.first, self.rest = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        self.floor = bars.copy()  # scores below it are not among the k best
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def feed(self, ids, qs, bars, vectors) -> None:
        length = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(ids), STEP):
            some = order[at : at + STEP]
            self._step(ids[some], vectors[some], length[some])

    def _step(self, ids, vectors, length) -> None:
        # Rounding of the rotation is far below this slack.
        slack = 1e-6 * (1.0 + self.length * length[0])
        alive = np.flatnonzero(self.length * length[0] + slack >= self.floor)
        if not len(alive):
            return
        rotated = vectors @ self.axes
        rest = np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        for i in range(0, len(alive), 512):
            own = alive[i : i + 512]
            bound = self.first[own] @ rotated[:, : self.head].T + np.outer(self.rest[own], rest) + slack[own, None]
            bound[self.ids[own, None] == ids[None, :]] = -np.inf
            for q, row in zip(own.tolist(), bound, strict=True):
                left = np.flatnonzero((row >= self.floor[q]) & (row > -np.inf))
                if len(left):
                    self._score(q, ids[left], vectors[left])

    def _score(self, q: int, ids, vectors) -> None:
        scores, held = self.best[q]
        # Whole numbers below 2^53 each; their products and sums are below it too, or are taken in 64 bits.
        exact = vectors @ self.whole[q] if vectors.shape[1] * np.abs(vectors).max() * np.abs(self.whole[q]).max() < 2**53 else vectors.astype(np.int64) @ self.whole[q].astype(np.int64)
        s, v = np.concatenate([scores, exact.astype(np.int64)]), np.concatenate([held, ids])
        keep = np.lexsort((v, -s))[: self.k]
        self.best[q] = s[keep], v[keep]
        if len(keep) == self.k:
            self.floor[q] = max(self.floor[q], float(s[keep[-1]]))

    def finish(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        columns = [np.repeat(self.ids, n), np.repeat(self.qs, n), *(np.concatenate([b[i] for b in self.best]) for i in (1, 0))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "q", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of floor(256 * x).

    Candidates are all rows but those with the query's own id; ties go to the smaller id; with
    fewer candidates all are returned. Null, empty or non-finite vectors and null ids take no
    part; shorter vectors count as padded with zeros. Rows that repeat an id all count as
    candidates, rows equal in id and vector each; queries that repeat an id have an answer each,
    but those equal in the vector too have one. An empty table gives no rows. Other columns are
    ignored. Raises ValueError where an inner product may not fit into 64 bits.
    """
    rows = usable(vectors, id_col, vec_col, zero_ok=True)
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(SCALE * x).cast("double")).alias("embedding"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x)
    whole = whole.withColumn("length", F.sqrt(squares))
    # Components beyond what a double holds exactly can be found by their magnitude alone.
    most = rows.select(F.size("embedding").alias("n"), F.array_max(F.transform("embedding", lambda x: F.abs(x * SCALE) + 1)).alias("m")).agg(F.count("*").alias("rows"), F.max("n").alias("width"), F.max("m").alias("m")).first()
    if not most.rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most.width * most.m**2 >= 2**62:
        raise ValueError(f"inner products of {most.width} components of up to {most.m:.3g} do not fit into 64 bits")
    width, n = most.width, max(1, min(QUANTILES, blocks.BLOCKS, -(-most.rows // blocks.BLOCK_ROWS)))
    cuts = whole.agg(F.percentile_approx("length", [i / n for i in range(1, n)], 10 * n).alias("c")).first().c if n > 1 else []
    cuts = np.array(sorted(set(cuts), reverse=True))

    def by_length(batches):
        for batch in batches:
            b = np.searchsorted(-cuts, -np.asarray(batch.column(1)), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), *batch.columns], ["b", *batch.schema.names])

    dealt = written(whole.select("vec_id", "length", "embedding").mapInArrow(by_length, "b int, vec_id long, length double, embedding array<double>"), "vector-blocks")
    sizes, longest = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1)
    for r in dealt.groupBy("b").agg(F.count("*").alias("n"), F.max("length").alias("m")).collect():
        sizes[r.b], longest[r.b] = r.n, r.m
    axes = principal_axes(whole, width)
    # The lengths of blocks descend, so a query visits some of the first.
    begin = min(int(np.searchsorted(np.cumsum(sizes), k + 1)), len(sizes) - 1)
    asked = written(queries_of(dealt, is_query), "vector-queries")
    state = lambda ids, qs, bars, vectors: Scores(ids, qs, bars, vectors, axes, k)
    schema = "query_id long, q long, vec_id long, score long"
    none = F.lit(float("-inf"))
    first = asked.select(F.explode(F.sequence(F.lit(0), F.lit(begin))).alias("b"), "vec_id", "q", none.alias("bar"), "embedding")
    found = written(visit(dealt, first, sizes, False, state, schema, width), "vector-first")
    if begin + 1 < len(sizes):
        best = ranked(found, F.col("score").desc(), k).groupBy("query_id", "q").agg(F.min("score").cast("double").alias("bar"), F.count("*").alias("n"))
        best = best.select(F.col("query_id").alias("vec_id"), "q", F.when(F.col("n") == k, F.col("bar")).alias("bar"))
        more = asked.join(best, ["vec_id", "q"], "left").select("vec_id", "q", F.coalesce("bar", none).alias("bar"), "embedding")

        def reached(batches):
            for batch in batches:
                x, bar = dense(batch.column(3), width), np.asarray(batch.column(2))
                length = np.sqrt((x**2).sum(1))
                may = np.outer(length, longest[begin + 1 :]) * (1 + 1e-9) + 1 >= bar[:, None]
                of, b = np.nonzero(may & (sizes[begin + 1 :] > 0))
                some = batch.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([pa.array((b + begin + 1).astype(np.int32)), *some.columns], ["b", *batch.schema.names])

        later = written(more.mapInArrow(reached, "b int, vec_id long, q long, bar double, embedding array<double>"), "vector-visits")
        found = found.unionAll(visit(dealt, later, sizes, False, state, schema, width))
    return ranked(found, F.col("score").desc(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e AS q, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
