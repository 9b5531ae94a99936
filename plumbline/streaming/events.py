"""Incremental input: bounded batches, upserts by key, windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.lineage import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream writes until its input is used up, read back as a table."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def totalled(stream: DataFrame, name: str) -> DataFrame:
    """The final state of an aggregation over a stream, when its input is used up; each batch replaces the table of the one before."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_events(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events by key once, as long as repeats come within ``late`` of event time."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, length: str = "1 hour") -> DataFrame:
    """(begin, event_type, n, total): counts and sums over windows of event time; needs a watermark on a stream."""
    value = F.col("value").cast("decimal(18,4)")
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def upserted(stream: DataFrame, path: str, key: str, newest: str) -> str:
    """Keeps the newest row of each key in a table that each batch replaces by a new version; returns the last version's path.

    A batch that is run again writes its version again from the one before it.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = rows.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v{batch_id - 1}"))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), F.col(newest)).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    return f"{path}/v{progress['batchId']}" if progress else path
