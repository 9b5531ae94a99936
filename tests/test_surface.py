"""The service surface, archives and bundles."""

import bz2
import io
import json
import struct
import tarfile

import pytest

from plumbline.operators import catalog
from plumbline.plans import api
from plumbline.sources import archives


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [
        ("r1", "area", "region", "Rhode Island", "", "", ""), ("r2", "area", "region", "Oregon", "", "", ""), ("l1", "area", "locality", "Newport", "", "", "r1"), ("l2", "area", "locality", "Newport", "", "", "r2"),
        ("l3", "area", "locality", "Saint Paul", "", "", "r1"), ("s1", "street", "", "Thames St", "", "", ""), ("s2", "street", "", "Thames St", "", "", ""), ("b1", "business", "", "White Horse Tavern", "26 Marlborough St", "", ""),
        ("a1", "address", "", "26 Marlborough St", "26 Marlborough St, Newport, RI", "", "l1"),
    ]
    at = {"l1": (41.49, -71.31), "l2": (44.63, -124.05), "s1": (41.48, -71.32), "s2": (44.6, -124.0), "a1": (41.49, -71.31), "b1": (41.49, -71.31)}
    full = [(k, kind, sub, name, address, alias, False, 1, 0.0, "", parent, *at.get(k, (41.5, -71.4))) for k, kind, sub, name, address, alias, parent in rows]
    schema = "key string, kind string, subtype string, name string, address string, alias string, closed boolean, prominence int, confidence double, class_name string, parent string, lat double, lng double"
    return api.Lookup(catalog.entities(spark.createDataFrame(full, schema)))


def keys(lookup):
    return {r.id: r.key for r in lookup.entities.select("id", "key").collect()}


def test_autocomplete(spark, lookup):
    regions = spark.createDataFrame([("RI", "rhode island"), ("OR", "oregon")], "region_code string, region string")
    none = (None,) * 4
    asked = [(1, "26 marlborough street", *none), (2, "Newport, OR", *none), (3, "Thames St, Newport, RI", *none), (4, "white hor", *none), (5, "newport", 44.0, -125.0, 45.0, -123.0), (6, "x" * 201, *none), (7, " ", *none), (8, "newport", 45.0, 0.0, 44.0, 1.0), (9, "St Paul, RI", *none)]
    name = keys(lookup)
    got = {}
    for r in lookup.autocomplete(spark.createDataFrame(asked, "query_id int, input string, south double, west double, north double, east double"), regions).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((name[r.id], r.text, r.types))
    assert got[1] == [("a1", "26 Marlborough St, Newport, RI", ["street_address"])]
    assert [x[0] for x in got[2]] == ["l2"] and [x[0] for x in got[3]] == ["s1"]
    assert got[4][0][:2] == ("b1", "White Horse Tavern, 26 Marlborough St")
    assert got[5][0][0] == "l2" and {6, 7, 8}.isdisjoint(got)
    assert got[9] == [("l3", "St. Paul", ["locality", "political"])]


def test_details_and_geocode(spark, lookup):
    name = keys(lookup)
    some = [(i,) for i, k in name.items() if k in ("l3", "b1")] + [("nothing",)]
    rows = lookup.details(spark.createDataFrame(some, "id string"), "id,displayName.text,location.latitude").collect()
    assert sorted((name[r.id], r.displayName.text) for r in rows) == [("b1", "White Horse Tavern"), ("l3", "St. Paul")]
    asked = [(1, "26 Marlborough St, RI", None, None), (2, None, 41.49, -71.31), (3, "x", 1.0, 1.0), (4, None, None, None), (5, "main", None, None), (6, None, 41.6, -71.31)]
    got = {r.query_id: (r.status, name.get(r.id)) for r in lookup.geocode(spark.createDataFrame(asked, "query_id int, address string, lat double, lng double")).collect()}
    assert got == {1: ("OK", "a1"), 2: ("OK", "a1"), 3: ("INVALID_REQUEST", None), 4: ("INVALID_REQUEST", None), 5: ("INVALID_REQUEST", None), 6: ("ZERO_RESULTS", None)}


def test_address_parts(spark):
    rows = spark.createDataFrame([("1", "Elm", "Newport", "RI", "US", ""), ("2", "", None, "ON", "CA", "K1")], "number string, street string, locality string, region string, country string, postcode string")
    got = [[(c.long_name, c.short_name) for c in r.components] for r in api.address_parts(rows).collect()]
    assert got == [[("1", "1"), ("Elm", "Elm"), ("Newport", "Newport"), ("Rhode Island", "RI"), ("United States", "US")], [("2", "2"), ("ON", "ON"), ("CA", "CA"), ("K1", "K1")]]


def package(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return bz2.compress(out.getvalue())


def test_packages(spark, tmp_path):
    (tmp_path / "a.tar.bz2").write_bytes(package({"0/000/001.gph": b"one", "0/000/002.gph": b"two"}))
    (tmp_path / "b.tar.bz2").write_bytes(package({"0/000/001.gph": b"one", "0/000/002.gph": b"other"}))
    members = archives.read_packages(spark, str(tmp_path))
    assert members.count() == 4 and archives.distinct_members(members).count() == 3
    assert [r.path for r in archives.conflicting_members(members).collect()] == ["0/000/002.gph"]


def shapefile(shapes):
    body = b""
    for i, rings in enumerate(shapes.values(), 1):
        points = [p for r in rings for p in r]
        cuts = [sum(len(r) for r in rings[:j]) for j in range(len(rings))]
        content = struct.pack("<I4dII", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(cuts)}I", *cuts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">II", i, len(content) // 2) + content
    shp = bytearray(100)
    struct.pack_into(">I", shp, 0, 9994)
    struct.pack_into(">I", shp, 24, (100 + len(body)) // 2)
    struct.pack_into("<II", shp, 28, 1000, 5)
    field = b"STUSPS".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([2]) + b"\0" * 15
    dbf = bytearray(32) + field + b"\r" + b"".join(b" " + k.encode().ljust(2) for k in shapes)
    struct.pack_into("<IHH", dbf, 4, len(shapes), 65, 3)
    return bytes(shp) + body, bytes(dbf)


def test_polygons(spark):
    square = [(-72.0, 41.0), (-72.0, 43.0), (-70.0, 43.0), (-70.0, 41.0), (-72.0, 41.0)]
    hole = [(-71.5, 41.5), (-71.5, 42.0), (-71.0, 42.0), (-71.0, 41.5), (-71.5, 41.5)]
    shp, dbf = shapefile({"RI": [square, hole], "OR": [[(-124.0, 44.0), (-124.0, 45.0), (-123.0, 45.0), (-124.0, 44.0)]]})
    by = archives.parse_polygons(shp, dbf, "STUSPS")
    assert by["RI"] == [square, hole]
    points = spark.createDataFrame([(1, 41.2, -71.8), (2, 41.7, -71.2), (3, 44.9, -123.9), (4, 44.1, -123.1), (5, 0.0, 0.0)], "id int, lat double, lng double")
    assert sorted(tuple(r) for r in archives.covered(points, archives.polygons(spark, by)).collect()) == [(1, "RI"), (3, "OR")]
    for bad in ((shp[:-8], dbf), (shp, dbf[:40]), (b"\1" + shp[1:], dbf)):
        with pytest.raises(ValueError):
            archives.parse_polygons(*bad, "STUSPS")
    with pytest.raises(ValueError):
        archives.parse_polygons(shp, dbf, "NAME")


def test_bundle(spark, tmp_path):
    record = lambda i, **a: {"source": "s", "source_id": str(i), "release": "r", "priority": 1, "kind": "business", "attributes": a, "paths": {}, "raw": "{}", "attributions": []}
    doc = {"schema": 2, "identities": {"s:1": "s:2", "s:9": "s:1"}, "records": [record(1, name="A"), record(2, colour="red"), record(2, name="B")], "relationships": [{"from": "s:1", "to": "s:7", "kind": "near", "evidence": "x"}], "rejections": [{"source_key": "s:1", "reason": "r", "raw": ""}]}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    got = {r.check: r.n for r in archives.bundle_violations(archives.read_bundle(spark, str(tmp_path / "b.json"))).collect()}
    assert got == {"duplicate_records": 1, "unknown_attributes": 1, "unknown_relations": 1, "loose_ends": 1, "identities_without_record": 1, "accepted_and_rejected": 1}
