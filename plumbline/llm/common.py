"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on local[N]) a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Bytes of an Arrow batch: however long the texts are, a task holds so many at a time.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, unless it was set by hand."""
    if spark.conf.get(BATCH_SETTING) == "67108864b":  # Spark's own default
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage.

    The folder goes when the application's file system is closed.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A size that follows the executors' memory, from the session's ``spark.plumbline.<name>``. It never changes results."""
    return int(spark.conf.get(f"spark.plumbline.{name}", str(default)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """``names``, with underscores after those that are taken."""
    held, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id) -> object:
    """Rows that no classifier may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, int64 offsets of each, validity; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if not valid.all():
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), valid
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], valid


Batches = Iterator[pa.RecordBatch]


def _release() -> None:
    """Gives back what the allocators of this worker hold unused; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal_batches(mapper: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A mapper of record batches that leaves no memory behind."""

    def run(batches: Batches) -> Batches:
        try:
            yield from mapper(batches)
        finally:
            _release()

    return run


def frugal_frame(mapper: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A mapper of a large group that leaves no memory behind."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return mapper(frame)
        finally:
            _release()

    return run


def frugal_pair(mapper: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A mapper of two large groups that leaves no memory behind."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return mapper(left, right)
        finally:
            _release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal neighbours."""
    if not len(values):
        return []
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return list(zip(begins, [*begins[1:], len(values)], strict=True))
