"""Lines, staging, contexts and snapping rules."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import polyline
from plumbline.operators import staging

LINE = [(41.0, -71.0), (41.0, -70.0), (41.0, -70.0), (42.0, -70.0)]


def line(spark, points=LINE):
    return spark.createDataFrame([([{"lat": a, "lng": b} for a, b in points],)], "p array<struct<lat:double,lng:double>>")


def test_projection_on_a_line(spark):
    df = line(spark)
    at = lambda lat, lng: df.select(polyline.project(F.col("p"), F.lit(lat), F.lit(lng)).alias("x")).first().x
    on = at(41.0, -70.5)
    assert on.gap < 1e-6 and 0 < on.fraction < 0.5 and (on.point.lat, on.point.lng) == (41.0, -70.5)
    assert at(43.0, -70.0).fraction == pytest.approx(1.0) and at(40.0, -72.0).fraction == 0.0
    assert at(41.5, -69.9).point.lat == pytest.approx(41.5)
    assert line(spark, LINE[:1]).select(polyline.project(F.col("p"), F.lit(1.0), F.lit(1.0)).alias("x")).first().x is None


def test_part_of_a_line(spark):
    df = line(spark)
    whole = df.select(polyline.total_length(F.col("p")).alias("n")).first().n
    got = df.select(polyline.part(F.col("p"), F.lit(0.25), F.lit(0.75)).alias("x")).first().x
    assert got[0].lat == 41.0 and -71.0 < got[0].lng < -70.0 and got[1].lng == -70.0 and 41.0 < got[-1].lat < 42.0
    half = df.select(polyline.total_length(polyline.part(F.col("p"), F.lit(0.25), F.lit(0.75))).alias("n")).first().n
    assert half == pytest.approx(whole / 2, rel=1e-4)
    every = df.select(polyline.part(F.col("p"), F.lit(0.0), F.lit(1.0)).alias("x")).first().x
    assert [(round(a.lat, 9), round(a.lng, 9)) for a in every] == [(41.0, -71.0), (41.0, -70.0), (42.0, -70.0)]


def test_staging_resumes_and_refuses(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"a": spark.range(10), "b": spark.range(3)}

    path = f"file://{tmp_path}/stage"
    for _ in range(2):
        assert {k: v.count() for k, v in staging.staged(spark, path, {"release": "1"}, build).items()} == {"a": 10, "b": 3}
    assert built == [1]
    with pytest.raises(ValueError, match="staged for"):
        staging.staged(spark, path, {"release": "2"}, build)
    spark.range(1).write.mode("append").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="lacks"):
        staging.staged(spark, path, {"release": "1"}, build)


def test_address_labels(spark):
    cases = {"12 MAIN St.": "12 main street", "É_x  ave": "é_x avenue", "": "", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", staging.address_label(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_contexts(spark):
    raw = lambda **p: json.dumps({"properties": p})
    rows = [
        ("e", "s1", 1, raw(country="US", postcode="02840", address_levels=[{"value": "RI"}, {"value": "Newport"}])), ("e", "s0", 9, raw(postcode="9")), ("e", "s2", 1, raw(country="CA")),
        ("f", "s3", 1, raw(addresses=[{"locality": "Lyon", "country": "FR"}])), ("g", "s4", 1, "{}"),
    ]
    got = {r.entity_id: tuple(r)[1:] for r in staging.contexts(spark.createDataFrame(rows, "entity_id string, source_key string, priority int, raw string")).collect()}
    assert got == {"e": ("Newport", "RI", "US", "02840", "Newport RI US 02840"), "f": ("Lyon", "", "FR", "", "Lyon FR")}


def test_snapping_rules(spark):
    schema = "edge_id long, start_node long, end_node long, class int, shortcut boolean, bridge boolean, tunnel boolean"
    rows = [(1, 1, 2, 4, False, False, False), (2, 2, 1, 4, False, None, None), (3, 3, 4, 1, False, False, False), (4, 5, 6, 4, True, False, False), (5, 7, 8, 4, False, True, False), (6, 9, 10, 4, False, False, False)]
    edges = spark.createDataFrame(rows, schema)
    got = staging.snap_eligible(edges, edges.where("edge_id in (1, 3, 4, 5)"))
    assert sorted(r.edge_id for r in got.collect()) == [1, 2]


def test_a_sound_catalog_has_no_faults_and_a_damaged_one_has(spark):
    from plumbline.operators import catalog, integrity
    from plumbline.plans.lookup import places
    from plumbline.plans.queries import QUERIES

    e = places(spark, "/root/testdata/sf0.001")
    p, s, a = catalog.postings(e), catalog.corpus_stats(e), catalog.address_lookup(e)
    sound = {r.check: r.n for r in integrity.catalog_checks(e, p, s, a).collect()}
    assert len(sound) == 25 and not any(sound.values())
    none = {r.check: r.n for r in integrity.catalog_checks(e.limit(0), p.limit(0), catalog.corpus_stats(e.limit(0)), a.limit(0)).collect()}
    assert len(none) == 25 and not any(none.values())
    damaged = {r.check: r.n for r in QUERIES["catalog_integrity"](spark, "/root/testdata/sf0.01").collect()}
    assert [c for c, n in damaged.items() if not n] == ["entities_without_id"]
    nameless = e.withColumn("id", F.when(F.col("k") != 100, F.col("id")))
    assert {r.check for r in integrity.catalog_checks(nameless, p, s, a).collect() if r.n} >= {"entities_without_id", "postings_without_entity"}
    rows = spark.createDataFrame([(x,) for x in (3, 4, 4, 7)], "nr long")
    assert tuple(integrity.contiguity(rows, "nr").first()) == (3, 7, 4, 2, 1) and tuple(integrity.contiguity(rows.limit(0), "nr").first()) == (None, None, 0, 0, 0)


def test_searches_with_the_words_of_a_viewport(spark):
    from plumbline.operators import catalog, search

    rows = [("a", "address", "1 Elm St", 10.0, 20.0), ("b", "address", "2 Oak St", 10.001, 20.0), ("c", "address", "3 Oak St Salem MA", 50.0, 20.0), ("d", "address", "9 Far St", 10.2, 20.0)]
    raw = spark.createDataFrame(rows, "key string, kind string, name string, lat double, lng double")
    raw = raw.withColumns({"subtype": F.lit(""), "address": F.lit(""), "alias": F.lit(""), "closed": F.lit(False), "parent": F.lit("")})
    e = catalog.entities(raw)
    parts = e.select("id", F.when(F.col("key") == "b", "Old Town, Salem").when(F.col("key") == "d", "Lynn").otherwise("").alias("locality"), F.lit("MA").alias("region"))
    views = spark.createDataFrame([(1, 9.5, 19.5, 10.5, 20.5), (2, 0.0, 0.0, 60.0, 60.0), (3, -1.0, -1.0, 1.0, 1.0)], "query_id long, south double, west double, north double, east double")
    words = search.viewport_words(views, e, parts)
    assert [tuple(r) for r in words.collect()] == [(1, "salem ma")]  # a is nearer but lacks a locality, d is too far
    typed = spark.createDataFrame([(1, "oak"), (2, "oak"), (3, " ")], "query_id long, input string")
    key = {r.id: r.key for r in e.select("id", "key").collect()}
    got = search.search_in_view(typed, words, catalog.postings(e), catalog.corpus_stats(e)).collect()
    assert sorted((r.query_id, r.rank, key[r.id]) for r in got if r.query_id == 1) == [(1, 1, "c"), (1, 2, "b")]
    assert {key[r.id] for r in got if r.query_id == 2} == {"b", "c"} and not [r for r in got if r.query_id == 3]
