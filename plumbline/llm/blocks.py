"""A stated set of query vectors against all rows, dealt into blocks that a bound can rule out.

An index gives each row one block. A query visits a first block, and with what it has found
there only those others that may hold something better. A task has one side in memory, rows
or queries, and the other streams by; a block with many rows (a group of copies, say) is cut
into parts, and one with many queries is visited in several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import frugal_batches, mix

#: Rows of a block that are wanted, and blocks there are at most: what the driver holds of the index is bounded by them.
BLOCK_ROWS, BLOCKS = 16_384, 65_536
#: Queries of a task.
QUERY_ROWS = 4_096


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: not those without an id, nor null or empty vectors, nor ones with null or non-finite components."""
    v = F.col("embedding")
    limit = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    keep = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    if not zero_ok:
        keep &= F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(keep)


def queries_of(rows: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, q, embedding) of the queries, once each; ``q`` tells queries apart whose id repeats."""
    return rows.where(is_query).select("vec_id", F.xxhash64("vec_id", "embedding").alias("q"), "embedding").dropDuplicates(["vec_id", "q"])


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones count as padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


MET = "b int, part int, salt int, kind int, vec_id long, q long, bar double, embedding array<double>"
MET_NAMES = ["b", "part", "salt", "kind", "vec_id", "q", "bar", "embedding"]


def visit(rows: DataFrame, asked: DataFrame, sizes: np.ndarray, rows_held: bool, state: Callable, schema: str, width: int) -> DataFrame:
    """What ``state(ids, qs, bars, vectors)`` of a task's held side makes of the other: by ``feed`` of each batch, and by ``finish``.

    ``rows`` is (b, vec_id, embedding), each row in one block; ``asked`` is (b, vec_id, q, bar,
    embedding), a query for each block that it visits. ``sizes`` are the rows of each block.
    """
    parts = np.maximum(1, -(-sizes // (2 * BLOCK_ROWS)))
    salts = np.ones(len(sizes), np.int64)
    for r in asked.groupBy("b").agg(F.count("*").alias("n")).collect():
        salts[r.b] = -(-r.n // QUERY_ROWS)
    row_kind = 0 if rows_held else 1

    def deal(is_row: bool):
        def run(batches):
            at = 0
            for batch in batches:
                b = np.asarray(batch.column("b"))
                copies = (salts if is_row else parts)[b]
                of = np.repeat(np.arange(len(b)), copies)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(copies) - copies, copies)
                own = (np.arange(at, at + len(b)) if is_row else mix(np.asarray(batch.column("q")).view(np.uint64)).view(np.int64) & 0x7FFFFFFF) % (parts if is_row else salts)[b]
                at += len(b)
                own = own[of]
                part, salt = (own, nth) if is_row else (nth, own)
                some = batch.take(pa.array(of)) if len(of) != len(b) or (copies != 1).any() else batch
                n = len(of)
                q, bar = (pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n))) if is_row else (some.column("q"), some.column("bar"))
                columns = [some.column("b"), pa.array(part.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(np.full(n, row_kind if is_row else 1 - row_kind, np.int32)), some.column("vec_id"), q, bar, some.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, MET_NAMES)

        return run

    @frugal_batches
    def meet(batches):
        task, held, now = None, [], None

        def begun():
            return state(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else None

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1)
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(keys) else []
            for a, z in zip(begins, [*begins[1:], len(keys)], strict=True):
                if (here := tuple(keys[a, :3].tolist())) != task:
                    if now is not None and (out := now.finish()) is not None:
                        yield out
                    task, held, now = here, [], None
                some = batch.slice(a, z - a)
                side = [*(np.asarray(some.column(i)) for i in (4, 5, 6)), dense(some.column(7), width)]
                if keys[a, 3] == 0:
                    held.append(side)
                    continue
                if now is None:
                    now, held = begun(), []
                if now is not None and (out := now.feed(*side)) is not None:
                    yield out
        if now is not None and (out := now.finish()) is not None:
            yield out

    names = ["b", "vec_id", "embedding"]
    both = rows.select(*names).mapInArrow(deal(True), MET).unionAll(asked.select("b", "vec_id", "q", "bar", "embedding").mapInArrow(deal(False), MET))
    task = ["b", "part", "salt"]
    return both.repartition(*task).sortWithinPartitions(*task, "kind").mapInArrow(meet, schema)


def ranked(found: DataFrame, score_order: Column, k: int) -> DataFrame:
    """The best k of each query over all blocks: each visit has sent k at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "q").orderBy(score_order, F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
