"""Resolution of source records into entities, relationships, and checks on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import DEGREE_METRES, distance
from plumbline.functions.text import public_id

LINK_METRES = 50.0


def anchored(records: DataFrame, identities: DataFrame) -> DataFrame:
    """``records`` (source_key, …) with the entity id of the anchor: the mapped key, or the record's own."""
    mapped = records.join(identities.select("source_key", "target"), "source_key", "left")
    return mapped.withColumn("entity_id", public_id(F.coalesce("target", "source_key"))).drop("target")


def chained_identities(identities: DataFrame) -> DataFrame:
    """Mappings whose target is itself mapped, which is forbidden."""
    return identities.join(identities.select(F.col("source_key").alias("target")), "target", "left_semi").select("source_key", "target")


def absent(value: Column) -> Column:
    """Null, empty text and empty lists are no value; false is one."""
    return value.isNull() | value.isin("", "null", '""', "[]")


def resolved(attributes: DataFrame) -> DataFrame:
    """(entity_id, attribute, value, source_key): of (entity_id, attribute, value, source_key, priority) the first
    present value by priority, highest first, then by source key."""
    w = Window.partitionBy("entity_id", "attribute").orderBy(F.desc("priority"), "source_key")
    present = attributes.where(~absent(F.col("value")))
    return present.withColumn("at", F.row_number().over(w)).where("at = 1").select("entity_id", "attribute", "value", "source_key")


def attribution_union(records: DataFrame) -> DataFrame:
    """(entity_id, providers): distinct attributions in the order of first use by priority and key.

    An entity's records are few; the list is bounded by the number of providers.
    """
    first = records.groupBy("entity_id", "provider").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("source_key").alias("k"))).alias("at"))
    lists = first.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "provider"))).alias("all"))
    return lists.select("entity_id", F.array_join(F.transform("all", lambda x: x["provider"]), ",").alias("providers"))


def distinct_relationships(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_id", "to_id", "kind").agg(F.min("evidence").alias("evidence"))


def resolved_endpoints(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges between source keys as edges between entities; an end without an entity keeps a null for the gate to find."""
    of = lambda name: keys.select(F.col("source_key").alias(name), F.col("entity_id").alias(f"{name}_id"))
    return edges.join(of("from"), "from", "left").join(of("to"), "to", "left").select("from_id", "to_id", "kind", "evidence")


def unique_links(businesses: DataFrame, addresses: DataFrame, metres: float = LINK_METRES) -> DataFrame:
    """(source_key, matches, address_key): addresses with the same label and postcode prefix within reach.

    Only a business with a single match is linked; ``address_key`` is null for the others.
    """
    key, place = ["label", "postcode"], ["lat", "lng"]
    # Records of one label at one point have the same links, so points meet, not records; those without a point or a label have none.
    spots = addresses.dropna(subset=[*key, *place]).groupBy(*key, *place).agg(F.count("*").alias("n"), F.min("source_key").alias("one"))
    asked = businesses.select(*key, F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng")).dropna().distinct()
    # A point meets the cells of a box that is a little wider than its reach; longitudes go round.
    up = metres / DEGREE_METRES * 1.001
    size = max(int(0.5 / up), 1)  # cells to a degree
    cell = lambda c: F.floor(c * size).cast("long")
    wide = F.least(F.lit(180.0), up / F.greatest(F.cos(F.radians(F.least(F.abs("b_lat") + up, F.lit(90.0)))), F.lit(1e-9)))
    near = asked.withColumn("cy", F.explode(F.sequence(cell(F.col("b_lat") - up), cell(F.col("b_lat") + up))))
    near = near.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("b_lng") - wide), cell(F.col("b_lng") + wide)), lambda c: F.pmod(c, F.lit(360 * size))))))
    there = spots.withColumns({"cy": cell(F.col("lat")), "cx": F.pmod(cell(F.col("lng")), F.lit(360 * size))})
    hits = near.join(there, [*key, "cy", "cx"]).where(distance(F.col("b_lat"), F.col("b_lng"), F.col("lat"), F.col("lng")) <= metres)
    found = hits.groupBy(*key, "b_lat", "b_lng").agg(F.sum("n").alias("matches"), F.min("one").alias("one"))
    own = businesses.select("source_key", *key, F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    own = own.join(found, [*key, "b_lat", "b_lng"]).groupBy("source_key").agg(F.sum("matches").alias("matches"), F.min("one").alias("one"))
    return own.select("source_key", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("address_key"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: rows beyond the first of each key."""
    return rows.agg((F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicates"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how many rows each check has found, zero included."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def completeness(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, rows, and the number of non-empty values of each field)."""
    filled = [F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f"has_{f}") for f in fields]
    return rows.groupBy(group).agg(F.count("*").alias("rows"), *filled)


def duplicate_labels(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, labels, excess): labels that occur more than once, and rows beyond the first of each."""
    many = rows.groupBy(group, label).agg(F.count("*").alias("n")).where("n > 1")
    return many.groupBy(group).agg(F.count("*").alias("labels"), F.sum(F.col("n") - 1).alias("excess"))
