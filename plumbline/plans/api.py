"""The service surface as functions: one request, or a table of them, in; ranked or nested rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import valid_viewport
from plumbline.functions.text import display_name
from plumbline.operators import catalog, geocode, search
from plumbline.sources.features import masked

RESULTS = 5
VIEWPORT = ("south", "west", "north", "east")


def place_types(kind: Column, subtype: Column) -> Column:
    """The public type names of an entity."""
    return (
        F.when(kind == "business", F.array(F.lit("establishment"), F.lit("point_of_interest")))
        .when(kind == "address", F.array(F.lit("street_address")))
        .when(kind == "street", F.array(F.lit("route")))
        .when((kind == "area") & (subtype == "locality"), F.array(F.lit("locality"), F.lit("political")))
        .when(kind == "area", F.array(F.lit("political")))
        .otherwise(F.array().cast("array<string>"))
    )


class Lookup:
    """A generation ready to be asked: its entities, postings and address tables."""

    def __init__(self, entities: DataFrame, closure: DataFrame | None = None) -> None:
        self.entities = entities
        self.postings = catalog.postings(entities)
        self.stats = catalog.corpus_stats(entities)
        self.addresses = catalog.address_lookup(entities)
        self.cells = catalog.address_cells(entities)
        self._closure = closure

    @property
    def closure(self) -> DataFrame:
        if self._closure is None:
            self._closure = search.ancestors(self.entities.where("kind = 'area'").select("id", "parent_id"))
        return self._closure

    def autocomplete(self, requests: DataFrame, region_names: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, text, types): at most five suggestions for each (query_id, input[, south, west, north, east]).

        An input that parses as an address is answered by forward geocoding; one of the form
        ``city, state`` or ``street, city, state`` by its context; others by text, re-ranked
        where the request has a viewport. Inputs of no or over 200 characters, and invalid
        viewports, get no row. ``region_names`` (region_code, region) names the regions' areas.
        """
        own = requests.where((F.trim("input") != "") & (F.length("input") <= 200))
        has_view = all(c in requests.columns for c in VIEWPORT)
        if has_view:
            bare = F.col("south").isNull()
            own = own.where(bare | valid_viewport(*[F.col(c) for c in VIEWPORT]))
        asked = own.select("query_id", "input")
        found = geocode.forward(asked, self.addresses).where("id is not null")
        w = Window.partitionBy("query_id").orderBy("id")
        exact = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= RESULTS).select("query_id", "rank", "id")
        rest = asked.join(exact, "query_id", "left_anti")
        parts = [exact]
        if region_names is not None:
            parsed = search.parsed_context(rest).join(region_names, "region_code")
            areas = search.in_context(parsed.where("locality is null").select("query_id", "name", "region"), self.entities, self.closure)
            anchors = search.in_context(parsed.where("locality is not null").select("query_id", F.col("locality").alias("name"), "region"), self.entities, self.closure).where("rank = 1")
            located = anchors.join(self.entities.select("id", "lat", "lng"), "id").join(parsed.select("query_id", "name"), "query_id").select("query_id", "name", "lat", "lng")
            streets = search.street_near(located, self.entities).select("query_id", F.lit(1).alias("rank"), "id")
            parts += [areas, streets]
            rest = rest.join(parsed, "query_id", "left_anti")
        free = search.unstructured(rest, self.entities, self.postings, self.stats)
        if has_view:
            viewed = own.where(F.col("south").isNotNull()).select("query_id", "input", *VIEWPORT)
            # More candidates for those that are re-ranked, after the plain answer.
            pool = search.merged_first([free, search.posting_search(viewed.join(exact, "query_id", "left_anti").select("query_id", "input"), self.postings, self.stats, 25)], 25)
            ranked = search.viewport_ranked(pool.join(viewed.select("query_id"), "query_id", "left_semi"), viewed, self.entities).select("query_id", "rank", "id")
            free = free.join(viewed.select("query_id"), "query_id", "left_anti").unionAll(ranked)
        parts.append(free)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p.select("query_id", "rank", "id"))
        shown = self.entities.select("id", "kind", "subtype", "name", "address")
        label = display_name(F.col("kind"), F.col("subtype"), F.col("name"))
        plain = (F.col("address") == "") | (F.col("address") == F.col("name"))
        text = F.when(plain, label).when(F.col("kind") == "address", F.col("address")).otherwise(F.concat_ws(", ", label, "address"))
        return out.join(shown, "id").select("query_id", "rank", "id", text.alias("text"), place_types(F.col("kind"), F.col("subtype")).alias("types"))

    def details(self, ids: DataFrame, mask: str) -> DataFrame:
        """Entities by id, with the fields of a mask; unknown ids have no row."""
        rows = self.entities.select("id", F.struct(display_name(F.col("kind"), F.col("subtype"), F.col("name")).alias("text")).alias("displayName"), F.col("address").alias("formattedAddress"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("location"), place_types(F.col("kind"), F.col("subtype")).alias("types"))
        return masked(rows.join(ids.select("id").distinct(), "id"), mask)

    def geocode(self, requests: DataFrame) -> DataFrame:
        """(query_id, status, outcome, id) of requests with exactly one of address and (lat, lng)."""
        forward, backward = requests.where("address is not null and lat is null"), requests.where("address is null and lat is not null")
        a = geocode.forward(forward.select("query_id", F.col("address").alias("input")), self.addresses).select("query_id", "outcome", "id")
        bounds = self.entities.agg(F.min("lat"), F.min("lng"), F.max("lat"), F.max("lng")).first()
        b = geocode.reverse(backward.select("query_id", "lat", "lng"), self.cells, tuple(x if x is not None else 0.0 for x in bounds)).select("query_id", "outcome", "id")
        both = requests.where("(address is null) = (lat is null)").select("query_id", F.lit("invalid_request").alias("outcome"), F.lit(None).cast("string").alias("id"))
        status = F.when(F.col("id").isNotNull(), "OK").when(F.col("outcome").isin("invalid_request", "invalid_input", "unsupported_input"), "INVALID_REQUEST").otherwise("ZERO_RESULTS")
        return a.unionAll(b).unionAll(both).select("query_id", status.alias("status"), "outcome", "id")


def address_parts(rows: DataFrame) -> DataFrame:
    """Adds ``components`` ARRAY<STRUCT<long_name, short_name, types>> of the non-empty address parts, US names spelled out."""
    us = F.col("country") == "US"
    long_region = F.when(us & (F.col("region") == "RI"), "Rhode Island").otherwise(F.col("region"))
    long_country = F.when(us, "United States").otherwise(F.col("country"))
    part = lambda short, long_, *types: F.struct(F.coalesce(long_, F.lit("")).alias("long_name"), F.coalesce(F.col(short), F.lit("")).alias("short_name"), F.array(*map(F.lit, types)).alias("types"))
    every = F.array(
        part("number", F.col("number"), "street_number"), part("street", F.col("street"), "route"), part("locality", F.col("locality"), "locality", "political"),
        part("region", long_region, "administrative_area_level_1", "political"), part("country", long_country, "country", "political"), part("postcode", F.col("postcode"), "postal_code"),
    )
    return rows.withColumn("components", F.filter(every, lambda c: c["short_name"] != ""))
