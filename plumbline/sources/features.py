"""Provider features: Parquet with bounding boxes and WKB, GeoJSON, JSON lines, and their projection to records."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.operators.ingest import Box, overlaps

POINT, LINE = 1, 2
GEOMETRY = StructType([StructField("type", StringType()), StructField("points", ArrayType(StructType([StructField("lat", DoubleType()), StructField("lng", DoubleType())])))])
FEATURE = """type string, geometry struct<type:string,coordinates:string>, properties struct<id:string,subtype:string,class:string,country:string,number:string,street:string,postcode:string,
  names:struct<primary:string,common:array<array<string>>,rules:array<struct<value:string,variant:string>>>,
  addresses:array<struct<freeform:string,locality:string,postcode:string,region:string,country:string>>,address_levels:array<struct<value:string>>,websites:array<string>,operating_status:string,
  confidence:double,basic_category:string,taxonomy:struct<hierarchy:array<string>,primary:string>,parent_division_id:string,cartography:struct<prominence:int>>"""


def decode_wkb(raw: bytes) -> dict:
    """A point or a line, of either byte order and exact length, with finite coordinates in range."""
    if len(raw) < 5 or raw[0] > 1:
        raise ValueError("invalid WKB")
    order = "<" if raw[0] else ">"
    (kind,) = struct.unpack_from(f"{order}I", raw, 1)
    if kind == POINT:
        n, at = 1, 5
    elif kind == LINE and len(raw) >= 9:
        (n,), at = struct.unpack_from(f"{order}I", raw, 5), 9
    else:
        raise ValueError(f"unsupported WKB type {kind}")
    if len(raw) != at + 16 * n:
        raise ValueError("WKB has another length")
    numbers = struct.unpack_from(f"{order}{2 * n}d", raw, at)
    points = [{"lat": y, "lng": x} for x, y in zip(numbers[::2], numbers[1::2], strict=True)]
    if not all(abs(p["lat"]) <= 90 and abs(p["lng"]) <= 180 for p in points):
        raise ValueError("WKB coordinate out of range")
    return {"type": "Point" if kind == POINT else "LineString", "points": points}


@F.pandas_udf(GEOMETRY)
def wkb(raw: pd.Series) -> pd.DataFrame:
    """STRUCT<type, points> of a WKB column; null for null, an error for anything invalid."""
    return pd.DataFrame([{"type": None, "points": None} if b is None else decode_wkb(bytes(b)) for b in raw], columns=["type", "points"])


def read_boxes(spark: SparkSession, paths: list[str], boxes: list[Box]) -> DataFrame:
    """Features of Parquet files whose bounding boxes meet any box; the comparison is pushed into the scan."""
    return spark.read.parquet(*paths).where(overlaps("bbox", boxes))


def assets(catalog: DataFrame, kind: str, boxes: list[Box], allowed: str = "s3://") -> list[str]:
    """Distinct addresses of the assets of one kind that meet any box. A catalog lists files, not rows."""
    rows = catalog.where((F.col("collection") == kind) & F.col("href").startswith(allowed) & F.col("href").endswith(".parquet")).where(overlaps("bbox", boxes))
    return [r.href for r in rows.select("href").distinct().orderBy("href").collect()]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(type, geometry, properties) of each feature of feature collections; unknown shapes are an error."""
    whole = spark.read.schema(f"type string, features array<struct<{_fields(FEATURE)}>>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return whole.where("type = 'FeatureCollection'").select(F.explode("features").alias("f")).select("f.*")


def _fields(ddl: str) -> str:
    """``a b, c d`` as ``a:b,c:d`` at the top level."""
    out, depth, part = [], 0, ""
    for c in " ".join(ddl.split()):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    out.append(part.strip())
    return ",".join(":".join(x.split(" ", 1)) for x in out)


def coordinates(rows: DataFrame) -> DataFrame:
    """Adds points ARRAY<STRUCT<lat, lng>> from GeoJSON points and lines."""
    nested = F.when(F.col("geometry.type") == "Point", F.concat(F.lit("["), F.col("geometry.coordinates"), F.lit("]"))).otherwise(F.col("geometry.coordinates"))
    pairs = F.from_json(nested, "array<array<double>>")
    return rows.withColumn("points", F.transform(pairs, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng"))))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or not, in which a bare NaN stands for null."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    # A string, which is kept as it is, or a bare NaN.
    repaired = F.regexp_replace("value", r'("(?:[^"\\]|\\.)*")|\bNaN\b', "$1\u0000")
    repaired = F.replace(F.regexp_replace(repaired, "(\"(?:[^\"\\\\]|\\\\.)*\")\u0000", "$1"), F.lit("\u0000"), F.lit("null"))
    return raw.select(F.from_json(repaired, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, which a feature file must not have."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def present(*parts: Column) -> Column:
    """Non-blank parts joined by a comma and a blank."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: F.trim(p) != ""), ", ")


def valid_website(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://") & (F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def records(features: DataFrame, kind: str) -> DataFrame:
    """(source_key, kind, subtype, name, address, website, aliases, closed, points) of place, address, division or segment features."""
    p = F.col("properties")
    street = F.trim(F.concat_ws(" ", p["number"], p["street"]))
    first = F.get(p["addresses"], F.lit(0))
    common = F.coalesce(F.transform(p["names"]["common"], lambda x: x[1]), F.array().cast("array<string>"))
    rules = F.coalesce(F.transform(p["names"]["rules"], lambda x: x["value"]), F.array().cast("array<string>"))
    aliases = F.array_sort(F.array_distinct(F.filter(F.concat(common, rules), lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & ~x.eqNullSafe(p["names"]["primary"]))))
    levels = F.coalesce(F.transform(p["address_levels"], lambda x: x["value"]), F.array().cast("array<string>"))
    spelled = {
        "place": present(first["freeform"], first["locality"], first["region"], first["postcode"], first["country"]),
        "address": F.array_join(F.filter(F.concat(F.array(street), levels, F.array(F.coalesce(p["postcode"], F.lit("")), F.coalesce(p["country"], F.lit("")))), lambda x: x != ""), ", "),
    }
    return coordinates(features).select(
        F.concat(F.lit(f"overture:{kind}:"), p["id"]).alias("source_key"),
        F.lit({"place": "business", "division": "area", "segment": "street"}.get(kind, kind)).alias("kind"),
        p["subtype"].alias("subtype"),
        (street if kind == "address" else p["names"]["primary"]).alias("name"),
        spelled.get(kind, F.lit("")).alias("address"),
        F.get(F.filter(p["websites"], valid_website), F.lit(0)).alias("website"),
        aliases.alias("aliases"),
        F.coalesce(p["operating_status"] == "permanently_closed", F.lit(False)).alias("closed"),
        "points",
    )


def area_evidence(features: DataFrame) -> DataFrame:
    """(source_key, prominence, tier) of divisions: prominence from 1 to 100, settlement tier from hamlet 1 to city 4."""
    p = F.col("properties")
    prominence = p["cartography"]["prominence"]
    checked = F.when(prominence.isNull(), 0).when(prominence.between(1, 100), prominence).otherwise(F.raise_error(F.lit("prominence out of range")).cast("int"))
    tier = F.when(p["class"] == "city", 4).when(p["class"] == "town", 3).when(p["class"] == "village", 2).when(p["class"] == "hamlet", 1).otherwise(0)
    return features.select(F.concat(F.lit("overture:division:"), p["id"]).alias("source_key"), checked.alias("prominence"), tier.alias("tier"))


def inventory_differences(digests: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, digest, side): what a digest file and a directory listing do not share."""
    return digests.exceptAll(listing).withColumn("side", F.lit("digests")).unionAll(listing.exceptAll(digests).withColumn("side", F.lit("listing")))


def masked(rows: DataFrame, mask: str) -> DataFrame:
    """Columns by a comma-separated field mask: paths into structs and arrays of structs, or ``*``; an unknown path is an error."""
    if mask.strip() == "*":
        return rows
    wanted: dict[str, list[str]] = {}
    for path in filter(None, (x.strip() for x in mask.split(","))):
        head, _, rest = path.partition(".")
        if head not in rows.columns:
            raise ValueError(f"unsupported field {path}")
        wanted.setdefault(head, []).append(rest)
    if not wanted:
        raise ValueError("empty field mask")
    return rows.select(*[_part(F.col(c), rows.schema[c].dataType, paths).alias(c) for c, paths in wanted.items()])


def _part(value: Column, kind, paths: list[str]) -> Column:
    if "" in paths or "*" in paths:
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _part(x, kind.elementType, paths))
    if not isinstance(kind, StructType):
        raise ValueError(f"unsupported field {paths[0]}")
    inner: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        if head not in kind.names:
            raise ValueError(f"unsupported field {p}")
        inner.setdefault(head, []).append(rest)
    return F.when(value.isNotNull(), F.struct(*[_part(value[c], kind[c].dataType, rest).alias(c) for c, rest in inner.items()]))
