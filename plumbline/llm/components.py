"""Connected components of an edge table, by alternating star contractions.

Each round hangs neighbours onto the smallest of their neighbourhood (first the larger
neighbours, then the smaller ones). The rounds are logarithmic in the number of vertices
in practice, and every step is an aggregation by minimum and a join; nothing reaches the
driver but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b); ``root`` is the smallest node that links reach.

    Nulls and loops are ignored; edges may repeat and point either way.
    """
    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        e = written(_small_star(_large_star(e)), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbourhood."""
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, go to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
