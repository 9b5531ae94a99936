"""Checkpoints of a batch build that a later run resumes from, and what is projected from sources."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import EXPANSIONS


def staged(spark: SparkSession, path: str, identity: dict[str, str], build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of a stage: read if ``path`` holds them for the same identity with all their rows, else built and written.

    The marker is written last, so that a run that was cut off is not taken for a whole one. A
    marker of another identity is an error: a stage is never overwritten.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_marker")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        marker = json.loads(spark.read.text(f"{path}/_marker").first()[0])
        if marker["identity"] != identity:
            raise ValueError(f"{path} was staged for {marker['identity']}")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in marker["rows"]}
        lost = {name: n for name, n in marker["rows"].items() if tables[name].count() != n}
        if lost:
            raise ValueError(f"{path} lacks rows of {sorted(lost)}")
        return tables
    rows = {}
    for name, table in build().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    marker = json.dumps({"identity": identity, "rows": rows})
    spark.createDataFrame([(marker,)], "value string").coalesce(1).write.text(f"{path}/_marker")
    return {name: spark.read.parquet(f"{path}/{name}") for name in rows}


def address_label(c: Column) -> Column:
    """An address for linking: lower case with accents kept, signs to blanks, abbreviations written out."""
    lookup = F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])
    spaced = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    return F.array_join(F.filter(F.transform(F.split(spaced, " "), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), lambda w: w != ""), " ")


CONTEXT = "properties struct<country:string,postcode:string,region:string,address_levels:array<struct<value:string>>,addresses:array<struct<locality:string,region:string,country:string,postcode:string>>>"


def contexts(sources: DataFrame) -> DataFrame:
    """(entity_id, locality, region, country, postcode, hierarchy) from the first source that tells any of them, by priority and key.

    ``sources`` has entity_id, source_key, priority and raw, a feature as JSON.
    """
    p = F.col("f.properties")
    first = F.get(p["addresses"], F.lit(0))
    us = (p["country"] == "US") & (F.size(p["address_levels"]) == 2)
    level = lambda i: F.when(us, F.get(p["address_levels"], F.lit(i))["value"])
    own = sources.withColumn("f", F.from_json("raw", CONTEXT)).select(
        "entity_id", "source_key", "priority",
        F.coalesce(first["locality"], level(1), F.lit("")).alias("locality"), F.coalesce(first["region"], level(0), p["region"], F.lit("")).alias("region"),
        F.coalesce(first["country"], p["country"], F.lit("")).alias("country"), F.coalesce(first["postcode"], p["postcode"], F.lit("")).alias("postcode"),
    )
    told = own.where("locality <> '' or region <> '' or country <> ''")
    w = Window.partitionBy("entity_id").orderBy(F.desc("priority"), "source_key")
    best = told.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    parts = F.filter(F.array("locality", "region", "country", "postcode"), lambda x: x != "")
    return best.select("entity_id", "locality", "region", "country", "postcode", F.array_join(parts, " ").alias("hierarchy"))


def snap_eligible(edges: DataFrame, open_edges: DataFrame) -> DataFrame:
    """Edges a point may snap to: no shortcut, of class 2 or lower standing, no bridge or tunnel, and open in one direction at least."""
    ways = open_edges.select(F.col("start_node").alias("a"), F.col("end_node").alias("b"))
    either = ways.unionAll(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = edges.where(~F.col("shortcut") & (F.col("class") >= 2) & ~F.coalesce(F.col("bridge"), F.lit(False)) & ~F.coalesce(F.col("tunnel"), F.lit(False)))
    return own.join(either, (own["start_node"] == either["a"]) & (own["end_node"] == either["b"]), "left_semi")
