"""Readers against files that the tests write."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from plumbline.sources import features, tiles


def word(fields, values):
    words = [0] * (1 + max(w for w, _, _ in fields.values()))
    for name, value in values.items():
        w, start, width = fields[name]
        assert value < 1 << width
        words[w] |= value << start
    return words


def zigzag(values):
    out = b""
    for v in values:
        v = v << 1 if v >= 0 else (-v << 1) - 1
        while v >= 128:
            out += bytes([v & 127 | 128])
            v >>= 7
        out += bytes([v])
    return out


def tile(base, nodes, edges, rules=(), restrictions=(), transitions=(), names=b"\0Main Street\0"):
    """nodes: field values; edges: (field values, way, name offset or None, [(lat, lng) in millionths])."""
    info, infos = b"", []
    for _, way, name, points in edges:
        infos.append(len(info))
        steps, last = [], (0, 0)
        for y, x in points:
            steps += [y - last[0], x - last[1]]
            last = (y, x)
        shape = zigzag(steps)
        count = 0 if name is None else 1
        info += struct.pack("<III", way & 0xFFFFFFFF, (way >> 32 & 255) << 24, count | len(shape) << 4 | (way >> 40 & 255) << 20)
        info += (struct.pack("<I", name) if count else b"") + shape
    info += b"\0" * 12
    body = b"".join(struct.pack("<4Q", *(word(tiles.NODE_FIELDS, n) + [0] * 4)[:4]) for n in nodes)
    body += b"".join(struct.pack("<Q", t) for t in transitions)
    body += b"".join(struct.pack("<6Q", *(word(tiles.EDGE_FIELDS, e | {"info": i}) + [0] * 6)[:6]) for (e, *_), i in zip(edges, infos, strict=True))
    body += b"".join(struct.pack("<2Q", *word(tiles.RULE_FIELDS, r)) for r in rules)
    forward = tiles.HEADER + len(body)
    for first, vias, last, kind, car in restrictions:
        body += struct.pack("<3Q", first, last, kind | car << 4 | len(vias) << 16) + b"".join(struct.pack("<Q", v) for v in vias)
    reverse = tiles.HEADER + len(body)
    text = reverse + len(info)
    size = text + len(names)
    header = bytearray(tiles.HEADER)
    struct.pack_into("<Q", header, 0, base)
    header[16:21] = b"3.4.0"
    struct.pack_into("<QQ", header, 40, len(nodes) | len(edges) << 21, len(transitions))
    struct.pack_into("<Q", header, 72, len(rules))
    struct.pack_into("<IIII", header, 96, forward, reverse, reverse, text)
    struct.pack_into("<II", header, 216, size, 0)
    struct.pack_into("<I", header, 224, size)
    return bytes(header) + body + info + names


BASE = 2 | 700_000 << 3


@pytest.fixture
def folder(tmp_path):
    nodes = [{"lat": 100_000, "lng": 50_000, "access": 1, "edge_index": 0, "edge_count": 1, "transition_index": 0, "transition_count": 1}, {"lat": 200_000, "lat_fine": 5, "lng": 60_000, "access": 3, "edge_index": 1, "edge_count": 1, "private": 1}]
    end = lambda i: BASE | i << 25
    edges = [
        ({"end_node": end(1), "forward": 1, "speed": 50, "use": 0, "access": 1, "length": 120, "class": 4}, 123_456_789_012, 1, [(41_000_000, -71_000_000), (41_000_500, -71_000_100), (41_001_000, -71_000_000)]),
        ({"end_node": end(0), "speed": 30, "destination": 1, "access": 3, "length": 120}, 7, None, [(41_000_000, -71_000_000), (41_001_000, -71_000_000)]),
    ]
    raw = tile(BASE, nodes, edges, [{"edge": 1, "type": 3, "modes": 1, "value": 2**40}], [(end(0), [end(5), end(6)], end(1), 2, 1), (end(1), [], end(0), 1, 0)], [3 << 3])
    path = tmp_path / tiles.path_of_id(BASE)
    path.parent.mkdir(parents=True)
    path.write_bytes(raw)
    (path.parent / "999.gph.gz").write_bytes(gzip.compress(raw))
    return tmp_path, raw


def test_tiles(spark, folder):
    path, raw = folder
    end = lambda i: BASE | i << 25
    nodes = tiles.read_tiles(spark, str(path), "nodes").distinct().orderBy("node_id").collect()
    lat, lng = -90 + 700_000 // 1440 * 0.25, -180 + 700_000 % 1440 * 0.25
    assert [(n.node_id, round(n.lat, 7), round(n.lng, 7), n.private, n.transitions) for n in nodes] == [(end(0), round(lat + 0.1, 7), round(lng + 0.05, 7), False, [24]), (end(1), round(lat + 0.2000005, 7), round(lng + 0.06, 7), True, [])]
    edges = tiles.read_tiles(spark, str(path), "edges").orderBy("edge_id").limit(4).collect()
    assert len(edges) == 4
    e = edges[0]
    assert (e.edge_id, e.start_node, e.end_node, e.speed, e.length, e.way, e.names, e.forward) == (end(0), end(0), end(1), 50, 120.0, 123_456_789_012, ["Main Street"], True)
    assert [(round(p.lat, 6), round(p.lng, 6)) for p in e.points] == [(41.0, -71.0), (41.0005, -71.0001), (41.001, -71.0)]
    assert [(round(p.lat, 6), round(p.lng, 6)) for p in edges[2].points] == [(41.001, -71.0), (41.0, -71.0)] and edges[2].destination
    assert [tuple(r) for r in tiles.read_tiles(spark, str(path), "rules").distinct().collect()] == [(end(1), 3, 1, 2**40)]
    assert [(r.path, r.type) for r in tiles.read_tiles(spark, str(path), "restrictions").distinct().collect()] == [([end(0), end(6), end(5), end(1)], 2)]


def test_damaged_tiles(folder):
    _, raw = folder
    for at, value in ((16, b"9"), (224, b"\1\1\1"), (96, b"\0\0\0\0"), (216, b"\xff\xff\xff"), (0, b"\7"), (56, b"\1")):
        bad = bytearray(raw)
        bad[at : at + len(value)] = value
        with pytest.raises(ValueError):
            tiles.Tile.parse(bytes(bad))
    with pytest.raises(ValueError):
        tiles.Tile.parse(raw[:100])
    with pytest.raises(ValueError):
        tiles.varints(b"\xff\xff\xff\xff\xff\xff")


def test_tile_paths(spark):
    rows = {"x/2/000/700/000.gph": BASE, "0/003/015.gph": 3015 << 3, "1/064/799.gph.gz": 64_799 << 3 | 1, "1/064/800.gph": None, "3/000/001.gph": None, "2/12/3.gph": None}
    got = spark.createDataFrame([(k,) for k in rows], "p string").select("p", tiles.id_of_path(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == rows
    assert tiles.path_of_id(BASE) == "2/000/700/000.gph" and tiles.path_of_id(3015 << 3) == "0/003/015.gph"


def test_wkb(spark):
    point = b"\1" + struct.pack("<Idd", 1, -71.0, 41.5)
    line = b"\0" + struct.pack(">IIdddd", 2, 2, -71.0, 41.0, -70.0, 42.0)
    got = [r.g for r in spark.createDataFrame([(point,), (line,), (None,)], "b binary").select(features.wkb("b").alias("g")).collect()]
    assert [(g.type, [tuple(p) for p in g.points or []]) for g in got] == [("Point", [(41.5, -71.0)]), ("LineString", [(41.0, -71.0), (42.0, -70.0)]), (None, [])]
    for bad in (b"", b"\2" + point[1:], point + b"x", b"\1" + struct.pack("<Idd", 3, 0, 0), b"\1" + struct.pack("<Idd", 1, 200.0, 0), b"\1" + struct.pack("<Idd", 1, float("nan"), 0)):
        with pytest.raises(ValueError):
            features.decode_wkb(bad)


def collection(*own):
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in own]}


def test_geojson_records(spark, tmp_path):
    point = {"type": "Point", "coordinates": [-71.3, 41.5]}
    place = {"id": "p1", "names": {"primary": "Café", "common": [["en", "Cafe"], ["fr", "Café"], ["es", ""]]}, "addresses": [{"freeform": "1 Main St", "locality": "Newport", "region": "RI", "country": "US"}], "websites": ["ftp://x", "https://ok.example"], "operating_status": "permanently_closed"}
    address = {"id": "a1", "number": "12", "street": "Elm St", "postcode": "02840", "country": "US", "address_levels": [{"value": "RI"}, {"value": "Newport"}]}
    segment = {"id": "s1", "subtype": "road", "names": {"primary": "Bay Rd", "rules": [{"value": "Route 1"}, {"value": "Bay Rd"}]}}
    (tmp_path / "f.json").write_text(json.dumps(collection((point, place), (point, address), ({"type": "LineString", "coordinates": [[-71, 41], [-70, 42]]}, segment))))
    rows = features.read_geojson(spark, str(tmp_path / "f.json"))
    assert rows.count() == 3
    of = lambda kind, key: [r for r in features.records(rows, kind).collect() if r.source_key.endswith(key)][0]
    p = of("place", "p1")
    assert (p.name, p.address, p.website, p.aliases, p.closed, p.kind) == ("Café", "1 Main St, Newport, RI, US", "https://ok.example", ["Cafe"], True, "business")
    assert [tuple(x) for x in p.points] == [(41.5, -71.3)]
    a = of("address", "a1")
    assert (a.name, a.address) == ("12 Elm St", "12 Elm St, RI, Newport, 02840, US")
    s = of("segment", "s1")
    assert s.aliases == ["Route 1"] and [tuple(x) for x in s.points] == [(41.0, -71.0), (42.0, -70.0)]
    assert features.unique(rows.select("properties.id"), "id").count() == 0


def test_area_evidence(spark):
    schema = "properties struct<id:string,class:string,cartography:struct<prominence:int>>"
    rows = spark.createDataFrame([(("a", "city", (80,)),), (("b", "hamlet", None),), (("c", None, (1,)),)], schema)
    assert sorted(tuple(r) for r in features.area_evidence(rows).collect()) == [("overture:division:a", 80, 4), ("overture:division:b", 0, 1), ("overture:division:c", 1, 0)]
    with pytest.raises(Exception, match="prominence"):
        features.area_evidence(spark.createDataFrame([(("a", "city", (101,)),)], schema)).collect()


def test_json_lines_with_bare_nan(spark, tmp_path):
    lines = ['{"x": NaN, "s": "NaN is \\"NaN\\""}', "", '{"x": 1.5, "s": null}', '{"x":NaN,"s":"a"}']
    with gzip.open(tmp_path / "f.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = [tuple(r) for r in features.read_json_lines(spark, str(tmp_path / "f.jsonl.gz"), "x double, s string").collect()]
    assert got == [(None, 'NaN is "NaN"'), (1.5, None), (None, "a")]


def test_boxes_are_pushed_into_the_scan(spark, tmp_path):
    box = F.struct(F.col("id").cast("double").alias("xmin"), (F.col("id") + 1.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax"))
    spark.range(100).select("id", box.alias("bbox")).write.parquet(f"{tmp_path}/f")
    rows = features.read_boxes(spark, [f"{tmp_path}/f"], [(10.5, 0.0, 12.5, 1.0)])
    assert sorted(r.id for r in rows.collect()) == [10, 11, 12]
    pushed = rows._jdf.queryExecution().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "bbox." in pushed and "LessThan" in pushed
    listed = spark.createDataFrame([("place", "s3://x/a.parquet", (0.0, 2.0, 0.0, 2.0)), ("place", "s3://x/a.parquet", (1.0, 3.0, 0.0, 2.0)), ("place", "http://x/b.parquet", (0.0, 2.0, 0.0, 2.0)), ("place", "s3://x/far.parquet", (50.0, 51.0, 0.0, 2.0))], "collection string, href string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    assert features.assets(listed, "place", [(0.5, 0.5, 1.5, 1.5)]) == ["s3://x/a.parquet"]


def test_field_masks(spark):
    rows = spark.createDataFrame([("a", (1, "x"), [(1, "p"), (2, "q")])], "id string, loc struct<lat:int,name:string>, parts array<struct<n:int,t:string>>")
    got = features.masked(rows, "id, loc.lat, parts.t")
    assert got.columns == ["id", "loc", "parts"]
    r = got.first()
    assert tuple(r.loc) == (1,) and [tuple(p) for p in r.parts] == [("p",), ("q",)]
    assert features.masked(rows, "*") is rows and features.masked(rows, "parts.*").first().parts[0].n == 1
    for bad in ("nope", "loc.nope", "id.x", " , "):
        with pytest.raises(ValueError):
            features.masked(rows, bad)


def test_inventory(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, digest string")
    b = spark.createDataFrame([("x", "1"), ("z", "3")], "name string, digest string")
    assert sorted(tuple(r) for r in features.inventory_differences(a, b).collect()) == [("y", "2", "digests"), ("z", "3", "listing")]
