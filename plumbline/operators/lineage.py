"""Cutting lineage so that a lost executor costs no more than the last step."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where all runs on one host."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="plumbline-")


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` without its lineage, in the folder that the cluster names for checkpoints."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints of plans that nothing refers to any more; it does so after a collection on the driver only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables written in the shared folder, which cut lineage as checkpoints do, are made by one run of their plan and tell Spark their size."""

    def __init__(self, spark: SparkSession, codec: str | None = None) -> None:
        self.spark = spark
        self.codec = {"compression": codec} if codec else {}
        self.held: dict[int, tuple[DataFrame, object]] = {}

    def write(self, rows: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/plumbline-{uuid.uuid4().hex}"
        rows.write.parquet(path, **self.codec)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._system(at).deleteOnExit(at)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.held[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan will read again, and what the runs before left."""
        for table in tables:
            _, at = self.held.pop(id(table))
            self._system(at).delete(at, True)
        released(self.spark)

    def _system(self, at):
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
