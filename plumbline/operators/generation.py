"""Immutable generations: digests, publication, comparison, gold checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(rows: DataFrame) -> DataFrame:
    """(n, digest) of a table, whatever the order of its rows and the layout of its files."""
    one = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def compared(old: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One row: how many keys were added, removed and kept, and how many kept ones differ in any field."""
    a = old.select(F.col(key).alias("a"), F.struct(*fields).alias("av"))
    b = new.select(F.col(key).alias("b"), F.struct(*fields).alias("bv"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    differs = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("av").eqNullSafe(F.col("bv"))
    return both.agg(
        F.count_if(F.col("a").isNull()).alias("added"),
        F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"),
        F.count_if(differs).alias("changed"),
    )


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either generation that the other has not, marked added or removed."""
    return new.subtract(old).withColumn("change", F.lit("added")).unionAll(old.subtract(new).withColumn("change", F.lit("removed")))


def publish(tables: dict[str, DataFrame], path: str, sort_key: dict[str, str], rows_per_file: int = 1_000_000) -> None:
    """Writes each table sorted by its key, then a manifest of row digests; refuses a path that exists.

    The manifest is written last: a folder without one is no generation.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, rows in tables.items():
        key = sort_key[name]
        rows.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(f"{path}/{name}")
        found = row_digest(spark.read.parquet(f"{path}/{name}")).first()
        manifest.append((name, found.n, found.digest))
    spark.createDataFrame(manifest, "name string, n long, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")


def verified(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published generation, after a check of their rows against the manifest."""
    out = {}
    for r in spark.read.schema("name string, n long, digest string").option("mode", "FAILFAST").json(f"{path}/_manifest").collect():
        rows = spark.read.parquet(f"{path}/{r.name}")
        found = row_digest(rows).first()
        if (found.n, found.digest) != (r.n, r.digest):
            raise ValueError(f"{path}/{r.name} is not what was published")
        out[r.name] = rows
    return out


class Selection:
    """A pointer to the current and the previous generation, kept in a small JSON file of the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path(path)
        self.next = jvm.org.apache.hadoop.fs.Path(path + ".next")
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> dict[str, str | None]:
        if not self.fs.exists(self.at):
            return {"current": None, "previous": None}
        lines = self.spark.read.text(self.at.toString()).collect()
        return json.loads("".join(r.value for r in lines))

    def _write(self, state: dict[str, str | None]) -> None:
        out = self.fs.create(self.next, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(self.at):
            self.fs.delete(self.at, False)
        self.fs.rename(self.next, self.at)

    def activate(self, generation: str) -> None:
        self._write({"current": generation, "previous": self.read()["current"]})

    def rollback(self) -> None:
        state = self.read()
        if not state["previous"]:
            raise ValueError("there is no previous generation")
        self._write({"current": state["previous"], "previous": state["current"]})


def gold_checks(checks: DataFrame, ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, results, ok) of (query_id, first_kind, first_name, min_results): null wishes always hold."""
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("results"))
    first = ranked.where("rank = 1").join(entities.select("id", "kind", "n_name"), "id").select("query_id", "kind", "n_name")
    rows = checks.join(counts, "query_id", "left").join(first, "query_id", "left")
    wish = lambda want, have: want.isNull() | F.coalesce(want == have, F.lit(False))
    ok = (F.coalesce("results", F.lit(0)) >= F.col("min_results")) & wish(F.col("first_kind"), F.col("kind")) & wish(F.col("first_name"), F.col("n_name"))
    return rows.select("query_id", F.coalesce("results", F.lit(0)).alias("results"), ok.alias("ok"))
