"""Queries that run a stream over the event table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.lookup import query
from plumbline.sources.places_view import read
from plumbline.streaming.events import drained, first_events, totalled, windowed


def _stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup_events", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup_events(spark, sf_dir):
    """Every event comes twice."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drained(first_events(twice), "events").select("event_id", "user_id", "event_type")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return totalled(windowed(_stream(spark, sf_dir)), "windows")
