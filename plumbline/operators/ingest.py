"""From provider features to records: scope, classification, geometry of streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import clip, distance, valid_point

Box = tuple[float, float, float, float]  # west, south, east, north


def overlaps(bbox: str, boxes: list[Box]) -> Column:
    """Whether a bounding-box column (xmin, ymin, xmax, ymax) meets any box; plain comparisons, which Parquet scans take."""
    out = F.lit(False)
    for w, s, e, n in boxes:
        out |= (F.col(f"{bbox}.xmin") < e) & (F.col(f"{bbox}.xmax") > w) & (F.col(f"{bbox}.ymin") < n) & (F.col(f"{bbox}.ymax") > s)
    return out


def in_boxes(lat: Column, lng: Column, boxes: list[Box]) -> Column:
    out = F.lit(False)
    for w, s, e, n in boxes:
        out |= lng.between(w, e) & lat.between(s, n)
    return out


def in_scope(kind: Column, country: Column, region: Column, inside: Column, regions: list[str]) -> Column:
    """Addresses and divisions must be in the US, places may lack a country; all but divisions must be in a listed region, if any is listed."""
    at_home = F.when(kind == "place", F.coalesce(country, F.lit("")).isin("", "US")).otherwise(F.coalesce(country == "US", F.lit(False)))
    listed = (kind == "division") | F.coalesce(region.isin(regions), F.lit(False)) if regions else F.lit(True)
    return inside & at_home & listed


def reject_reason(rows: DataFrame) -> Column:
    """Why a feature is left out, in a fixed order of tests; null if it is taken.

    ``rows`` has kind, subtype, name, label, search_text, inside (geometry) and scoped.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    street, address = F.col("kind") == "segment", F.col("kind") == "address"
    return (
        F.when(street & (F.col("subtype") != "road"), "non_road_segment")
        .when(street & (name == ""), "missing_primary_name")
        .when(street & ~F.col("inside"), "outside_manifest_geometry")
        .when(~street & ~F.col("scoped"), "outside_configured_scope")
        .when(address & (F.trim("label") == "") | (F.col("kind") == "place") & (name == ""), "missing_display_name")
        .when(F.col("search_text") == "", "missing_search_text")
    )


def valid_line(points: Column) -> Column:
    return (F.size(points) >= 2) & F.forall(points, lambda p: valid_point(p["lat"], p["lng"]))


def midpoints(lines: DataFrame, boxes: list[Box]) -> DataFrame:
    """(id, lat, lng): half-way along the parts of each line (id, points ARRAY<STRUCT<lat, lng>>) inside the boxes.

    Lines outside all boxes have no row; one whose parts have no length gets the start of the first.
    """
    pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    edges = lines.where(F.size("points") >= 2).select("id", F.posexplode(pairs).alias("pos", "e")).select("id", "pos", F.col("e.a.lng").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lng").alias("x2"), F.col("e.b.lat").alias("y2"))
    parts = F.filter(F.array(*[clip(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), b) for b in boxes]), lambda p: p.isNotNull())
    cut = edges.select("*", F.explode(parts).alias("p"))
    at = lambda t: (F.col("x1") + (F.col("x2") - F.col("x1")) * t, F.col("y1") + (F.col("y2") - F.col("y1")) * t)
    (ax, ay), (bx, by) = at(F.col("p.t0")), at(F.col("p.t1"))
    cut = cut.select("id", "pos", F.col("p.t0").alias("t0"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).withColumn("m", distance(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")))
    order = Window.partitionBy("id").orderBy("pos", "t0")
    cut = cut.withColumns({"run": F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("m").over(Window.partitionBy("id"))})
    half = cut.where(F.col("run") >= F.col("total") / 2).withColumn("at", F.row_number().over(order)).where("at = 1")
    t = F.when(F.col("m") > 0, (F.col("total") / 2 - (F.col("run") - F.col("m"))) / F.col("m")).otherwise(0.0)
    return half.select("id", (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("lat"), (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("lng"))
