"""Packages of tiles, polygon shapefiles, and import bundles."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.resolve import violations

MEMBER = "package string, path string, digest string, content binary"


def read_packages(spark: SparkSession, path: str, glob: str = "*.tar.bz2") -> DataFrame:
    """(package, path, digest, content) of the members of packages, each unpacked if gzipped."""

    def unpack(batches):
        import hashlib

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(bz2.decompress(raw))) as tar:
                    for member in tar:
                        if member.isfile():
                            content = tar.extractfile(member).read()
                            content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                            row = {"package": name, "path": member.name, "digest": hashlib.sha256(content).hexdigest(), "content": content}
                            yield pa.RecordBatch.from_pylist([row])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("package"), "content").mapInArrow(unpack, MEMBER)


def distinct_members(members: DataFrame) -> DataFrame:
    """(path, digest, content): members that several packages hold alike, once."""
    return members.groupBy("path", "digest").agg(F.any_value("content").alias("content"))


def conflicting_members(members: DataFrame) -> DataFrame:
    """Paths under which packages hold different contents, which is an error."""
    return members.groupBy("path").agg(F.count_distinct("digest").alias("variants")).where("variants > 1")


def parse_polygons(shp: bytes, dbf: bytes, field: str) -> dict[str, list[list[tuple[float, float]]]]:
    """Rings (x, y) by the value of a text field; raises ValueError where the files do not fit each other or the format."""
    if len(dbf) < 33 or len(shp) < 100:
        raise ValueError("short file")
    n, header, stride = struct.unpack_from("<IHH", dbf, 4)
    if header + n * stride > len(dbf):
        raise ValueError("short table")
    start, width, at = 0, 0, 1
    for i in range(32, header - 1, 32):
        name = dbf[i : i + 11].split(b"\0")[0].decode("ascii", "replace")
        if name == field:
            start, width = at, dbf[i + 16]
        at += dbf[i + 16]
    if not width:
        raise ValueError(f"no field {field}")
    keys = [dbf[header + i * stride + start :][:width].decode("ascii", "replace").strip() for i in range(n)]
    magic, kind = struct.unpack_from(">I", shp)[0], struct.unpack_from("<I", shp, 32)[0]
    if magic != 9994 or kind != 5 or struct.unpack_from(">I", shp, 24)[0] * 2 != len(shp):
        raise ValueError("not a file of polygons")
    out: dict[str, list[list[tuple[float, float]]]] = {}
    at, k = 100, 0
    while at < len(shp):
        number, words = struct.unpack_from(">II", shp, at)
        end = at + 8 + 2 * words
        if number != k + 1 or k >= n or end > len(shp) or words < 22 or keys[k] in out:
            raise ValueError("invalid polygon record")
        parts, points = struct.unpack_from("<II", shp, at + 44)
        if end != at + 52 + 4 * parts + 16 * points:
            raise ValueError("invalid polygon extent")
        cuts = [*struct.unpack_from(f"<{parts}I", shp, at + 52), points]
        if cuts != sorted(cuts) or cuts[0]:
            raise ValueError("invalid ring")
        flat = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        out[keys[k]] = [xy[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        at, k = end, k + 1
    if k != n:
        raise ValueError("table and shapes differ in number")
    return out


def polygons(spark: SparkSession, by: dict[str, list[list[tuple[float, float]]]]) -> DataFrame:
    """(key, ring): one row for each ring."""
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, rings in by.items() for ring in rings]
    return spark.createDataFrame(rows, "key string, ring array<struct<x:double,y:double>>")


def covered(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, key): which polygons hold each point (id, lat, lng), by the even-odd rule over all rings of a key.

    Rings meet points on whole degrees of their boxes, so a point is tested against those near it only.
    """
    from plumbline.functions.geo import in_ring

    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v)).cast("int"), F.floor(F.array_max(v)).cast("int"))
    own = rings.select("key", "ring", F.explode(span(xs)).alias("cx"), ys.alias("ys")).select("key", "ring", "cx", F.explode(span(F.col("ys"))).alias("cy"))
    at = points.select("id", "lat", "lng", F.floor("lng").cast("int").alias("cx"), F.floor("lat").cast("int").alias("cy"))
    hits = at.join(own, ["cx", "cy"]).withColumn("odd", in_ring(F.col("lng"), F.col("lat"), F.col("ring")).cast("int"))
    return hits.groupBy("id", "key").agg(F.sum("odd").alias("n")).where("n % 2 = 1").select("id", "key")


BUNDLE = """schema int, manifest struct<region:string,bbox:array<double>,release:string>, identities map<string,string>,
  records array<struct<source:string,source_id:string,release:string,priority:int,kind:string,attributes:map<string,string>,paths:map<string,string>,raw:string,attributions:array<struct<provider:string,providerUri:string>>>>,
  relationships array<struct<`from`:string,`to`:string,kind:string,evidence:string>>, rejections array<struct<source_key:string,reason:string,raw:string>>"""


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """records, identities, relationships and rejections of a bundle document; malformed ones are an error."""
    whole = spark.read.schema(BUNDLE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    of = lambda c: whole.select(F.explode(c).alias("r")).select("r.*")
    records = of("records").withColumn("source_key", F.concat_ws(":", "source", "source_id"))
    identities = whole.select(F.explode("identities").alias("source_key", "target"))
    return {"records": records, "identities": identities, "relationships": of("relationships"), "rejections": of("rejections")}


ATTRIBUTES = ("name", "address", "website", "subtype", "location", "closed", "aliases")
RELATIONS = ("address", "parent_area")


def bundle_violations(bundle: dict[str, DataFrame]) -> DataFrame:
    """(check, n): what a bundle must have none of before it is resolved."""
    records, edges = bundle["records"], bundle["relationships"]
    keys = records.select("source_key").distinct()
    ends = edges.select(F.explode(F.array("from", "to")).alias("source_key"))
    return violations({
        "duplicate_records": records.groupBy("source_key").agg(F.count("*").alias("n")).where("n > 1"),
        "unknown_attributes": records.select(F.explode(F.map_keys("attributes")).alias("a")).where(~F.col("a").isin(*ATTRIBUTES)),
        "unknown_relations": edges.where(~F.col("kind").isin(*RELATIONS)),
        "loose_ends": ends.join(keys, "source_key", "left_anti"),
        "identities_without_record": bundle["identities"].join(keys, "source_key", "left_anti"),
        "accepted_and_rejected": bundle["rejections"].join(keys, "source_key", "left_semi"),
    })
