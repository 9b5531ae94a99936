"""Operators on small tables with known results."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo, text
from plumbline.operators import catalog, generation, geocode, ingest, resolve, routing, search
from plumbline.streaming import events


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize(spark):
    cases = {
        "Café  Zürich": "cafe zurich", "12 Main St.": "12 main street", "ΟΔΟΣ": "οδοσ", "a_b-c": "a b c", "": "", "...": "", "5 Ave, Rd; BLVD": "5 avenue road boulevard",
        "İstanbul": "istanbul", "naïve Ｆ٣": "naive ｆ٣", None: None, "ct dr ln pl": "court drive lane place",
    }
    got = one(spark, "x string", [(k,) for k in cases], "x", text.normalize(F.col("x")))
    assert dict(got) == cases


def test_address_key(spark):
    cases = {"0012B Main St": "12b main street", "000 zero rd": "0 zero road", "12-14 main st": None, "main st": None, "12 ...": None, "7 Élan Ave": "7 elan avenue", " 5 x ": "5 x", None: None}
    assert dict(one(spark, "x string", [(k,) for k in cases], "x", text.address_key(F.col("x")))) == cases


def test_forward_outcomes(spark):
    lookup = spark.createDataFrame([("12 main street", "newport ri 02840 us", "a"), ("12 main street", "boston ma 02101 us", "b"), ("7 elm avenue", "", "c")], "address_key string, address_context string, id string")
    asked = {1: "12 Main St, Newport, Rhode Island", 2: "12 main st", 3: "7 Elm Ave", 4: "7 Elm Ave, RI", 5: "#2 elm", 6: " ", 7: "elm ave", 8: "12 main st, 02101, USA", 9: "12 main st, us newport", 10: "9" * 201}
    got = geocode.forward(spark.createDataFrame(list(asked.items()), "query_id int, input string"), lookup).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.outcome, r.id))
    assert found[1] == [("matched", "a")] and sorted(found[2]) == [("ambiguous", "a"), ("ambiguous", "b")]
    assert found[3] == [("matched", "c")] and found[4] == [("no_match", None)] and found[8] == [("matched", "b")] and found[9] == [("no_match", None)]
    assert [found[i][0][0] for i in (5, 6, 7, 10)] == ["unsupported_input", "invalid_input", "unsupported_input", "invalid_input"]


def test_waypoints(spark):
    e = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", 5.0, 6.0)], "id string, lat double, lng double")
    lookup = spark.createDataFrame([("1 elm street", "a", "boston us"), ("2 elm street", "b", "boston us"), ("2 elm street", "c", "salem us")], "address_key string, id string, address_context string")
    rows = [
        (1, 9.0, 8.0, "a", None), (2, None, None, "b", "1 Elm St"), (3, None, None, "zz", None), (4, None, None, None, "1 Elm St"), (5, None, None, None, "2 elm street"), (6, None, None, None, "2 elm street, salem"),
        (7, None, None, None, "7 elm street"), (8, None, None, None, "apt 3, 1 elm street"), (9, None, None, None, None), (10, 99.0, 8.0, None, None), (11, 9.0, None, None, " "), (12, 9.0, None, None, None),
    ]
    asked = spark.createDataFrame(rows, "query_id long, lat double, lng double, place_id string, input string")
    got = {r.query_id: tuple(r)[1:] for r in geocode.waypoints(asked, e, lookup).collect()}
    none = (None, None, None)
    assert got == {
        1: ("coordinate", None, 9.0, 8.0), 2: ("place", "b", 3.0, 4.0), 3: ("unknown_place", *none), 4: ("address", "a", 1.0, 2.0), 5: ("ambiguous_address", *none), 6: ("address", "c", 5.0, 6.0),
        7: ("unresolved_address", *none), 8: ("unsupported_address", *none), 9: ("missing", *none), 10: ("invalid_coordinate", *none), 11: ("unsupported_address", *none), 12: ("missing", *none),
    }
    assert geocode.waypoints(asked.limit(0), e, lookup).count() == 0


def test_context(spark):
    cases = {
        "Newport, RI": ("newport", None, "RI"), "St. Louis, Missouri": ("saint louis", None, "MO"), "Main St, St Paul, MN": ("main street", "saint paul", "MN"), "Hartford, CT": ("hartford", None, "CT"),
        "a, b, c, RI": None, "42, RI": None, "x": None, ", RI": None, "Paris, France": None, "Main St, 7, MN": None, "N, N Y": ("n", None, "NY"),
    }
    got = one(spark, "x string", [(k,) for k in cases], "x", text.context_of(F.col("x")))
    assert {k: None if v is None else tuple(v) for k, v in got} == cases


def test_text_match_class(spark):
    rows = [("a b", "a b", 0), ("a b", "the a b", 0), ("a", "a b", 1), ("a", "the a b", 1), ("b", "a b", 2)]
    assert one(spark, "q string, n string, c int", rows, text.text_match_class(F.col("q"), F.col("n"))) == [(r[2],) for r in rows]


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def test_viewports_across_the_date_line(spark):
    rows = [(-10.0, 170.0, 10.0, -170.0, 0.0, 175.0, True), (-10.0, 170.0, 10.0, -170.0, 0.0, -175.0, True), (-10.0, 170.0, 10.0, -170.0, 0.0, 0.0, False), (0.0, 0.0, 1.0, 1.0, 1.0, 1.0, True), (0.0, 0.0, 1.0, 1.0, 1.0001, 1.0, False)]
    c = [F.col(x) for x in ("s", "w", "n", "e", "lat", "lng")]
    got = one(spark, "s double, w double, n double, e double, lat double, lng double, ok boolean", rows, geo.contains(*c))
    assert got == [(r[-1],) for r in rows]
    assert one(spark, "w double, e double", [(170.0, -170.0), (170.0, -160.0), (0.0, 10.0)], geo.centre_lng(F.col("w"), F.col("e"))) == [(180.0,), (-175.0,), (5.0,)]
    assert one(spark, "x double", [(190.0,), (-190.0,), (180.0,), (540.0,)], geo.wrap_lng(F.col("x"))) == [(-170.0,), (170.0,), (180.0,), (-180.0,)]
    bad = [(2.0, 0.0, 1.0, 1.0), (0.0, 180.0, 1.0, -180.0), (None, 0.0, 1.0, 1.0), (-91.0, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)]
    assert one(spark, "s double, w double, n double, e double", bad, geo.valid_viewport(*c[:4])) == [(False,)] * 5


def test_reverse_limits_and_ties(spark):
    metre = 1 / 111_195.08
    addresses = [("a", 41.0, -71.0), ("b", 41.0 + 2 * 99.99 * metre, -71.0), ("z", 41.0 + 2 * 99.99 * metre, -71.0), ("far", 42.0, -71.0)]
    cells = geocode.cells_of(spark.createDataFrame(addresses, "id string, lat double, lng double"))
    points = [(1, 41.0, -71.0), (2, 41.0 + 2 * 99.99 * metre + 100.01 * metre, -71.0), (3, 41.0 + 99.99 * metre, -71.0), (4, 0.0, 0.0), (5, 100.0, 0.0), (6, 41.0 - 99.99 * metre, -71.0), (7, None, 0.0)]
    got = geocode.reverse(spark.createDataFrame(points, "query_id int, lat double, lng double"), cells, (40.0, -72.0, 43.0, -70.0)).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.outcome, r.id))
    assert found[1] == [("matched", "a")] and found[2] == [("no_match", None)] and sorted(found[3]) == [("matched", x) for x in "abz"]
    assert found[4] == [("outside_coverage", None)] and found[5] == [("invalid_input", None)] and found[6] == [("matched", "a")] and found[7] == [("invalid_input", None)]


def test_posting_search_needs_all_words(spark):
    places = [(f"k{i}", kind, "", name, address, alias, closed, 1, 0.0, "", "", 0.0, 0.0) for i, (kind, name, address, alias, closed) in enumerate([
        ("business", "White Horse Tavern", "26 Marlborough St", "", False), ("street", "White Horse Rd", "", "", False), ("street", "White Horse Rd", "", "", False),
        ("business", "White Horse Closed", "", "", True), ("area", "Horse", "", "white", False), ("business", "Black Horse", "", "", False),
    ])]
    e = catalog.entities(spark.createDataFrame(places, "key string, kind string, subtype string, name string, address string, alias string, closed boolean, prominence int, confidence double, class_name string, parent string, lat double, lng double"))
    p, s = catalog.postings(e), catalog.corpus_stats(e)
    asked = spark.createDataFrame([(1, "white hor"), (2, "white horse road"), (3, "horse"), (4, "zebra"), (5, " ")], "query_id int, input string")
    names = {r.id: r.name for r in e.collect()}
    got = {}
    for r in sorted(search.posting_search(asked, p, s).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(names[r.id])
    assert sorted(got[1]) == ["Horse", "White Horse Rd", "White Horse Tavern"] and "White Horse Closed" not in got[1]
    assert got[2] == ["White Horse Rd"] and got[3][0] == "Horse" and 4 not in got and 5 not in got


def test_ancestors_end_on_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", None), ("f", "d"), ("f", "x")]
    got = {tuple(r) for r in search.ancestors(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    up = {}
    for a, b in rows:
        up.setdefault(a, set()).add(b)
    want = set()
    for a in up:
        todo = [a]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b and (a, b) not in want:
                    want.add((a, b))
                    todo.append(b)
    assert got == want


def test_resolution_order_and_emptiness(spark):
    rows = [("e", "name", "", "s1", 9), ("e", "name", "A", "s3", 5), ("e", "name", "B", "s2", 5), ("e", "closed", "false", "s1", 1), ("e", "aliases", "[]", "s1", 9), ("e", "site", None, "s1", 9)]
    got = sorted(tuple(r) for r in resolve.resolved(spark.createDataFrame(rows, "entity_id string, attribute string, value string, source_key string, priority int").repartition(3)).collect())
    assert got == [("e", "closed", "false", "s1"), ("e", "name", "B", "s2")]


def test_identities(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "source_key string")
    identities = spark.createDataFrame([("b", "a"), ("c", "b")], "source_key string, target string")
    ids = {r.source_key: r.entity_id for r in resolve.anchored(records, identities).collect()}
    assert ids["a"] == ids["b"] != ids["c"] and len(ids["a"]) == 35
    assert [tuple(r) for r in resolve.chained_identities(identities).collect()] == [("c", "b")]


def test_midpoint_of_a_clipped_line(spark):
    lines = [(1, [(41.0, -75.0), (41.0, -71.0)]), (2, [(41.0, -72.0), (41.0, -71.0), (41.0, -71.0), (41.0, -70.0), (41.0, -60.0)]), (3, [(50.0, 0.0), (51.0, 0.0)]), (4, [(41.0, -71.5), (41.0, -71.5)])]
    rows = spark.createDataFrame([(i, [{"lat": a, "lng": b} for a, b in p]) for i, p in lines], "id int, points array<struct<lat:double,lng:double>>")
    got = {r.id: (round(r.lat, 6), round(r.lng, 6)) for r in ingest.midpoints(rows, [(-72.0, 40.0, -70.0, 42.0)]).collect()}
    assert got == {1: (41.0, -71.5), 2: (41.0, -71.0), 4: (41.0, -71.5)}


def test_generations(spark, tmp_path):
    rows = spark.createDataFrame([(f"id{i}", i, None if i % 3 else "x") for i in range(50)], "id string, n int, note string")
    path = f"file://{tmp_path}/g1"
    generation.publish({"entities": rows}, path, {"entities": "id"})
    assert generation.verified(spark, path)["entities"].count() == 50
    with pytest.raises(Exception, match="exist"):
        generation.publish({"entities": rows}, path, {"entities": "id"})
    assert generation.row_digest(rows).first() == generation.row_digest(rows.orderBy(F.desc("id")).select("note", "n", "id")).first()
    spark.createDataFrame([("x", 1, None)], rows.schema).write.mode("append").parquet(f"{path}/entities")
    with pytest.raises(ValueError, match="published"):
        generation.verified(spark, path)
    changed = rows.withColumn("note", F.when(F.col("n") == 1, "new").otherwise(F.col("note"))).where("n <> 0").unionAll(spark.createDataFrame([("z", 1, "")], rows.schema))
    assert tuple(generation.compared(rows, changed, ["n", "note"]).first()) == (1, 1, 49, 1)


def test_selection(spark, tmp_path):
    s = generation.Selection(spark, f"file://{tmp_path}/current.json")
    with pytest.raises(ValueError):
        s.rollback()
    s.activate("g1")
    s.activate("g2")
    assert s.read() == {"current": "g2", "previous": "g1"}
    s.rollback()
    assert s.read() == {"current": "g1", "previous": "g2"}


def edges_of(spark, rows):
    full = [(i, a, b, c) for i, (a, b, c) in enumerate(rows)]
    return spark.createDataFrame(full, "edge_id long, start_node long, end_node long, cost long")


def test_shortest_paths_agree_with_dijkstra(spark):
    r = random.Random(44)
    rows = [(r.randrange(30), r.randrange(30), r.randrange(1, 60)) for _ in range(110)]
    rows = [x for x in rows if x[0] != x[1]]
    got = {(x.source, x.node): x.cost for x in routing.shortest(edges_of(spark, rows), spark.createDataFrame([(0,), (7,)], "source long")).collect()}
    want = {}
    for s in (0, 7):
        heap = [(0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            if (s, n) in want:
                continue
            want[s, n] = d
            for a, b, c in rows:
                if a == n:
                    heapq.heappush(heap, (d + c, b))
    assert got == want


def test_turn_restrictions_agree_with_a_search_over_edges(spark):
    r = random.Random(9)
    rows = [x for x in [(r.randrange(14), r.randrange(14), r.randrange(1, 30)) for _ in range(70)] if x[0] != x[1]]
    banned = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] == b[0] and r.random() < 0.3}
    got = {x.node: x.cost for x in routing.restricted(edges_of(spark, rows), spark.createDataFrame(sorted(banned), "edge_id long, next_edge long"), spark.createDataFrame([(3,)], "source long")).collect()}
    heap, done, want = [(c, i) for i, (a, _, c) in enumerate(rows) if a == 3], set(), {}
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        want[rows[i][1]] = min(d, want.get(rows[i][1], d))
        for j, (a, b, c) in enumerate(rows):
            if a == rows[i][1] and b != rows[i][0] and (i, j) not in banned:
                heapq.heappush(heap, (d + c, j))
    assert got == want


def test_landmark_bounds_never_exceed_the_way(spark):
    r = random.Random(5)
    rows = [x for x in [(r.randrange(20), r.randrange(20), r.randrange(1, 60)) for _ in range(90)] if x[0] != x[1]]
    edges = edges_of(spark, rows)
    every = spark.createDataFrame([(i,) for i in range(20)], "source long")
    ways = {(x.source, x.node): x.cost for x in routing.shortest(edges, every).collect()}
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "origin long, target long")
    bounds = routing.landmark_bounds(pairs, routing.landmark_costs(edges, every.where("source < 3"))).collect()
    assert bounds and all(x.bound <= ways.get((x.origin, x.target), float("inf")) for x in bounds)


def test_ways_between_agree_with_ways_from_every_source(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(40), r.randrange(1, 6) * 5) for _ in range(130)]  # many ways of equal cost, parallel edges, loops
    edges = edges_of(spark, rows)
    pairs = spark.createDataFrame([(r.randrange(44), r.randrange(44)) for _ in range(25)] + [(2, 2), (3, 4), (3, 4)], "source long, target long")
    best = routing.shortest(edges, pairs.select("source").distinct())
    want = {tuple(x) for x in routing.paths(edges, best, pairs.distinct()).collect()}
    got = [(x.source, x.target, x.step, x.edge_id) for x in routing.ways_between(edges, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_ways_between_neighbours_stay_near(spark):
    rows = [(a, a + d, 10) for a in range(1, 120) for d in (-1, 1)]
    pairs = spark.createDataFrame([(5, 7), (60, 61), (119, 116)], "source long, target long")
    with pytest.raises(ValueError):  # a search to all nodes
        routing.shortest(edges_of(spark, rows), pairs.select("source"), max_rounds=12)
    assert {(x.source, x.target): x["count"] for x in routing.ways_between(edges_of(spark, rows), pairs, max_rounds=12).groupBy("source", "target").count().collect()} == {(5, 7): 2, (60, 61): 1, (119, 116): 3}


def test_ways_between_over_edges_of_no_cost(spark):
    edges = edges_of(spark, [(0, 1, 0), (1, 0, 0), (1, 2, 5), (0, 2, 5), (2, 3, 0), (3, 2, 0)])
    got = routing.ways_between(edges, spark.createDataFrame([(0, 3), (0, 1), (3, 0)], "source long, target long")).collect()
    assert {(x.target, x.step, x.edge_id) for x in got} == {(3, 0, 4), (3, 1, 3), (1, 0, 0)}
    assert routing.ways_between(edges.limit(0), edges.select(F.col("start_node").alias("source"), F.col("end_node").alias("target"))).isEmpty()


def test_automaton_finds_each_banned_sequence(spark):
    r = random.Random(2)
    rules = [[r.randrange(4) for _ in range(r.randrange(2, 5))] for _ in range(6)]
    table = {(x.state, x.edge_id): (x.next_state, x.banned) for x in routing.Automaton(rules).table(spark).collect()}
    for _ in range(300):
        path, state, hit = [r.randrange(4) for _ in range(12)], 0, False
        for k, e in enumerate(path):
            state, banned = table.get((state, e), (0, False))
            hit |= banned
            assert banned == any(path[max(0, k + 1 - len(s)) : k + 1] == s for s in rules)


def ways_without(rows, rules, source, keep=4):
    """node -> (cost, last edges) of the cheapest way that never goes straight back and holds no rule of up to ``keep`` edges."""
    heap, done, want = [(0, source, ())], set(), {}
    while heap:
        d, n, last = heapq.heappop(heap)
        if (n, last) in done:
            continue
        done.add((n, last))
        want.setdefault(n, (d, last))
        for j, (a, b, c) in enumerate(rows):
            way = (*last, j)
            if a == n and not (last and rows[last[-1]][0] == b) and not any(way[-len(s) :] == tuple(s) for s in rules):
                heapq.heappush(heap, (d + c, b, way[-keep:]))
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_banned_sequences_agree_with_a_search_over_last_edges(spark, seed):
    r = random.Random(seed)
    rows = [x for x in [(r.randrange(9), r.randrange(9), r.randrange(1, 30)) for _ in range(40)] if x[0] != x[1]]
    rules = [[r.randrange(len(rows))], [r.randrange(len(rows))] * 2]
    for _ in range(3):  # the ends of the cheapest ways, then those of the ways around them
        for s in (0, 4):
            rules += [list(last[-r.randrange(2, 5) :]) for _, last in ways_without(rows, rules, s).values() if len(last) > 1 and r.random() < 0.6]
    sources = spark.createDataFrame([(0,), (4,)], "source long")
    own = spark.createDataFrame([(x,) for x in rules], "edges array<long>")
    got = {(x.source, x.node): x.cost for x in routing.sequence_restricted(edges_of(spark, rows), own, sources).collect()}
    assert got == {(s, n): c for s in (0, 4) for n, (c, _) in ways_without(rows, rules, s).items()}
    assert got != {(s, n): c for s in (0, 4) for n, (c, _) in ways_without(rows, [], s).items()}


def test_no_banned_sequences_and_no_edges(spark):
    rows = [(0, 1, 5), (1, 0, 1), (1, 2, 7), (0, 1, 9)]
    source, none = spark.createDataFrame([(0,)], "source long"), spark.createDataFrame([], "edges array<long>")
    assert {(x.node, x.cost) for x in routing.sequence_restricted(edges_of(spark, rows), none, source).collect()} == {(0, 0), (1, 5), (2, 12)}
    assert [(x.node, x.cost) for x in routing.sequence_restricted(edges_of(spark, rows).limit(0), none, source).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        routing.sequence_restricted(edges_of(spark, rows), none, source, max_rounds=2)


def test_departures_of_junctions(spark):
    edges = edges_of(spark, [(0, 9, 1), (1, 9, 1), (2, 9, 1), (5, 9, 1)])
    links = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    got = {tuple(x) for x in routing.departures(edges, links((0, 1), (1, 7))).collect()}
    assert got == {(n, e) for n in (0, 1, 7) for e in (0, 1)} | {(2, 2), (5, 3)}
    with pytest.raises(ValueError, match="4 nodes"):
        routing.departures(edges, links((0, 1), (1, 2), (2, 3)))


def test_shapes_of_ways_join_end_to_end(spark):
    at = lambda *x: [{"lat": a, "lng": b} for a, b in x]
    shapes = [(1, at((0.0, 0.0), (0.0, 1.0), (0.0, 2.0))), (2, at((0.0, 2.000001), (1.0, 2.0))), (3, at((5.0, 5.0), (6.0, 5.0)))]
    shapes = spark.createDataFrame(shapes, "edge_id long, shape array<struct<lat:double,lng:double>>")
    steps = spark.createDataFrame([(0, 8, 1, 1), (0, 8, 0, 2), (0, 9, 1, 1), (0, 9, 0, 3)], "source long, target long, step int, edge_id long")
    got = {x.target: x for x in routing.joined_shapes(steps, shapes).collect()}
    assert got[8].joined and [tuple(p) for p in got[8].points] == [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (1.0, 2.0)] and 0.1 < got[8].gap < 0.2
    assert not got[9].joined and len(got[9].points) == 5 and got[9].gap > 100_000
    assert got[9].metres == pytest.approx(3 * 111_195, rel=0.01)


def test_canonical_nodes(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (10, 11), (7, 7)], "a long, b long")
    assert {r.node: r.canonical for r in routing.groups(links).collect()} == {3: 3, 5: 3, 9: 3, 10: 10, 11: 10, 7: 7}


def test_prefix_pushdown_and_top_k_plan(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("t"), "id").alias("token"), "id").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    plan = t.where(F.col("token").startswith("t12"))._jdf.queryExecution().toString()
    assert "StringStartsWith(token,t12)" in plan
    areas = search.exact_areas(spark.createDataFrame([(1, "x")], "query_id int, input string"), spark.createDataFrame([("a", "area", "region", "x", 1, False)], "id string, kind string, subtype string, n_name string, prominence int, closed boolean"))
    assert "WindowGroupLimit" in areas._jdf.queryExecution().toString()


def test_streams_match_batches(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    rows.limit(200).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    once = events.drained(events.first_events(events.read_stream(spark, f"{tmp_path}/in", rows.schema), late="90 days"), "once")
    assert once.count() == rows.count() and once.select("event_id").distinct().count() == rows.count()
    last = events.upserted(events.read_stream(spark, f"{tmp_path}/in", rows.schema), f"file://{tmp_path}/up", "user_id", "ts")
    got = {r.user_id: r.ts for r in spark.read.parquet(last).collect()}
    assert got == {r.user_id: r.ts for r in rows.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    live = events.windowed(events.read_stream(spark, f"{tmp_path}/in", rows.schema, 100).withWatermark("ts", "1 day"))
    closed = {(r.begin, r.event_type): r.n for r in events.drained(live, "windows").collect()}
    whole = {(r.begin, r.event_type): r.n for r in events.windowed(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_the_antimeridian_and_the_far_north(spark):
    from plumbline.operators import geocode, routing, search

    view = "query_id long, south double, west double, north double, east double"
    places = spark.createDataFrame([("a", "address", False, 10.0, 179.99), ("b", "address", False, 10.0, -179.985), ("c", "address", False, 10.0, 0.0), ("d", "address", False, 80.0, 20.2), ("e", "address", False, 80.0, 20.9)], "id string, kind string, closed boolean, lat double, lng double")
    v = spark.createDataFrame([(1, 9.5, 179.5, 10.5, -179.5), (2, 79.5, 19.0, 80.5, 21.0)], view)
    got = search.nearest_addresses(v, places).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d")]
    found = spark.createDataFrame([(1, "c"), (1, "b")], "query_id long, id string")
    assert [r.id for r in geocode.biased(found, v, places).orderBy("rank").collect()] == ["b", "c"]
    far = spark.createDataFrame([(1, 0.0, 100.0, 20.0, -100.0)], view)  # all outside but b, whose centre lies at 180
    assert [r.id for r in geocode.biased(spark.createDataFrame([(1, "c"), (1, "a")], "query_id long, id string"), far, places).orderBy("rank").collect()] == ["a", "c"]
    nodes = spark.createDataFrame([(1, 10.0, 179.995), (2, 10.0, -179.995), (3, 10.01, 179.995), (4, 10.01, 170.0)], "node_id long, lat double, lng double")
    edges = spark.createDataFrame([(7, 1, 2), (8, 3, 4), (9, 1, 2)], "edge_id long, start_node long, end_node long")
    points = spark.createDataFrame([(1, 10.0003, 179.9999), (2, 10.0003, -179.9999), (3, 10.0003, 0.0), (4, 10.0103, 175.0)], "query_id long, lat double, lng double")
    got = {r.query_id: r for r in routing.snapped(points, edges, nodes).collect()}
    assert {q: r.edge_id for q, r in got.items()} == {1: 7, 2: 7, 4: 8} and all(abs(r.metres - 33.4) < 0.1 for r in got.values())


def test_snapping_against_every_edge(spark):
    import math
    import random

    from plumbline.operators import routing

    r = random.Random(5)
    nodes = [(i, 60 + r.random() * 0.02, 5 + r.random() * 0.04) for i in range(40)]
    edges = [(100 - i, r.randrange(40), r.randrange(40)) for i in range(80)]
    points = [(i, 60 + r.random() * 0.02, 5 + r.random() * 0.04) for i in range(150)]
    at = {i: (a, b) for i, a, b in nodes}

    def sphere(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(math.sqrt(h))

    want = {}
    for q, lat, lng in points:
        k = math.cos(math.radians(lat))
        best = []
        for e, a, b in edges:
            (y1, x1), (y2, x2) = at[a], at[b]
            ax, ay, dx, dy = (x1 - lng) * k, y1 - lat, (x2 - x1) * k, y2 - y1
            t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            m = round(sphere(lat, lng, y1 + (y2 - y1) * t, x1 + (x2 - x1) * t), 3)
            if m <= 100:
                best.append((m, e))
        if best:
            want[q] = min(best)
    got = routing.snapped(spark.createDataFrame(points, "query_id long, lat double, lng double"), spark.createDataFrame(edges, "edge_id long, start_node long, end_node long"), spark.createDataFrame(nodes, "node_id long, lat double, lng double")).collect()
    assert len(want) > 50 and {r.query_id: (r.metres, r.edge_id) for r in got} == want


def test_bounded_search_and_ways_that_are_too_long(spark):
    import random

    import pytest as pt

    from plumbline.operators import routing

    r = random.Random(2)
    rows = [(i, r.randrange(30), r.randrange(30), r.randrange(1, 50)) for i in range(90)]
    edges = spark.createDataFrame([x for x in rows if x[1] != x[2]], "edge_id long, start_node long, end_node long, cost long")
    pairs = [(0, 5), (3, 17), (8, 29), (4, 4)]
    costs = routing.landmark_costs(edges, spark.createDataFrame([(1,), (12,)], "source long"))
    got = {(x.source, x.target): x.cost for x in routing.directed(edges, spark.createDataFrame(pairs, "source long, target long"), costs).collect()}
    best = {s: {s: 0} for s, _ in pairs}
    for s, d in best.items():
        for _ in range(40):
            for _, a, b, c in rows:
                if a in d and a != b and d[a] + c < d.get(b, 10**9):
                    d[b] = d[a] + c
    assert got == {(s, t): best[s][t] for s, t in pairs if t in best[s]}
    line = spark.createDataFrame([(i, i, i + 1, 1) for i in range(4)], "edge_id long, start_node long, end_node long, cost long")
    ways = routing.shortest(line, spark.createDataFrame([(0,)], "source long"))
    target = spark.createDataFrame([(0, 4)], "source long, target long")
    assert routing.paths(line, ways, target).count() == 4
    with pt.raises(ValueError, match="longer"):
        routing.paths(line, ways, target, max_rounds=3)


def test_house_numbers_and_units(spark):
    from plumbline.functions import text

    rows = ["12 Main St", "0012b  Elm Ave", "000 Zero Rd", "12-14 Main St", "Main St", "12", "12bb Oak Ln", "12 9th St", "7 Ünter Weg", "", "é12 x", "B Main", "5\tTab Way"]
    got = [r.k for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(text.address_key(F.col("x")).alias("k")).collect()]
    assert got == ["12 main street", "12b elm avenue", "0 zero road", None, None, None, None, None, "7 unter weg", None, None, None, "5 tab way"]
    units = ["Apt 4, 12 Main", "12 Main #2", "Suite", "unitary way", "12 floor_x", "FL. 3", "aptos", "", "ste"]
    got = [r.k for r in spark.createDataFrame([(i, x) for i, x in enumerate(units)], "i int, x string").orderBy("i").select(text.names_unit(F.col("x")).alias("k")).collect()]
    assert got == [True, True, True, False, False, True, False, False, True]


def test_searches_read_their_edges_once(spark):
    line = [(i, i, i + 1, 1) for i in range(20)]
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for x in rows:
            read.add(1)
            yield x

    schema = "edge_id long, start_node long, end_node long, cost long"
    edges = spark.createDataFrame(spark.sparkContext.parallelize(line, 1).mapPartitions(seen), schema)
    found = routing.shortest(edges, spark.createDataFrame([(0,)], "source long"))
    # More than the 14 rounds of the queries' SQL: a way of 20 edges has its cost.
    assert {(x.node, x.cost) for x in found.collect()} == {(i, i) for i in range(21)}
    assert read.value == len(line)


def test_links_meet_points_and_not_records(spark):
    r = random.Random(3)
    schema = "source_key string, label string, postcode string, lat double, lng double"
    spots = [(41 + r.random() * 0.002, lng + r.random() * 0.002) for lng in (-71.0, 179.999, -180.0) for _ in range(15)]
    rows = lambda kind, n: [(f"{kind}{i}", r.choice("ab"), r.choice(["1", None]), *r.choice(spots)) for i in range(n)]
    businesses, addresses = rows("b", 60), rows("a", 150)
    wrap = lambda x: x - 360 if x > 180 else x
    businesses, addresses = ([(*x[:4], wrap(x[4])) for x in side] for side in (businesses, addresses))
    sphere = lambda a, b: 2 * 6_371_008.8 * math.asin(math.sqrt(math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2))
    want = {}
    for b in businesses:
        near = [a[0] for a in addresses if a[1] == b[1] and a[2] == b[2] == "1" and sphere(a, b) <= 50]
        if near:
            want[b[0]] = (len(near), near[0] if len(near) == 1 else None)
    links = resolve.unique_links(spark.createDataFrame(businesses, schema), spark.createDataFrame(addresses, schema))
    assert len(want) > 10 and {x.source_key: (x.matches, x.address_key) for x in links.collect()} == want
    assert "cx" in links._jdf.queryExecution().optimizedPlan().toString()  # an equi-join on cells


def test_a_crowded_tile_is_cut_into_parts(spark, monkeypatch):
    r = random.Random(8)
    nodes = spark.createDataFrame([(i, 60 + r.random() * 0.02, 5 + r.random() * 0.04) for i in range(60)], "node_id long, lat double, lng double")
    edges = spark.createDataFrame([(i, r.randrange(60), r.randrange(60)) for i in range(400)], "edge_id long, start_node long, end_node long")
    points = spark.createDataFrame([(i, 60 + i % 50 * 0.0004, 5 + i % 50 * 0.0008) for i in range(200)], "query_id long, lat double, lng double")
    whole = {(x.query_id, x.edge_id, x.metres) for x in routing.snapped(points, edges, nodes).collect()}
    monkeypatch.setattr(routing, "PART_ROWS", 20)
    assert len(whole) > 100 and {(x.query_id, x.edge_id, x.metres) for x in routing.snapped(points, edges, nodes).collect()} == whole


def test_a_ladder_makes_each_rung_once(spark):
    from plumbline.operators import ladder
    from plumbline.plans.lookup import literal, places
    from plumbline.plans.more import TYPED

    e = places(spark, "/root/testdata/sf0.001")
    p, s = catalog.postings(e), catalog.corpus_stats(e)
    out = ladder.ladder(literal(spark, TYPED[:3], "query_id BIGINT, input STRING"), e, p, s)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("customer") <= 2 and {x.rung for x in out.collect()} <= {1, 2, 3}
