"""Queries over the places view: catalog, search, geocoding, resolution, ingest, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geo, text
from plumbline.operators import catalog, generation, geocode, ingest, resolve, search
from plumbline.plans import sql as S
from plumbline.sources.places_view import SOURCES, raw_places, read

INPUTS = [
    (1, "harbor market"), (2, "The Harbor 3 Mar"), (3, "red wid"), (4, "small ring st"), (5, "saint nation 3"), (6, "africa"), (7, "b"), (8, "12"),
    (9, "machinery ave"), (10, "nation_4"), (11, "Asia"), (12, "nothing like it"), (13, "the harbor 5 market"), (14, "blue"), (15, "  "), (16, "Cafés, 3"),
]
VIEWPORTS = [(i, s, -125.0 + i, s + 9.0, -125.0 + i + 30.0) for i, s in ((1, 24.0), (2, 30.0), (3, 40.0), (4, 26.0), (5, 25.0), (6, 24.0), (9, 35.0), (13, 41.0), (14, 28.0))] + [(10, 24.0, 170.0, 50.0, -100.0)]
CONTEXTS = [
    (1, "Saint Nation 3, Rhode Island"), (2, "St. Nation 3, ri"), (3, "St Nation 2, Connecticut"), (4, "Main St, Springfield, NY"), (5, "Portland"), (6, "a, b, c, d"),
    (7, ", ME"), (8, "42, ME"), (9, "New York, newyork"), (10, "Elm Ave, St. Paul, MN"), (11, "Paris, France"), (12, "Elm Ave, 5, MN"), (13, "St, CT"), (14, "Court, ct"),
]
ADDRESSES = [
    (1, "12 machinery St, Nation 11, US"), (2, "0012 machinery st"), (3, "12 machinery street, US"), (4, "10B building St"), (5, "10b building street, nation 9"),
    (6, "apt 4, 12 machinery st"), (7, "machinery st"), (8, ""), (9, "12-14 main st"), (10, "99999 nowhere rd"), (11, "19 household Lane, us, nation"), (12, "300 furniture Ave., United States"),
    (13, "000 zero st"), (14, None), (15, "7 furniture #2"),
]
POINTS = [(1, 24.0, -125.0), (2, 95.0, 0.0), (3, 10.0, 10.0), (4, None, 5.0)]
BOUNDS = (24.0, -125.0, 50.0, -66.0)
SPEC = "query_id BIGINT, input STRING"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entities(raw_places(spark, sf_dir), ascii_only=True)


def inputs(spark: SparkSession) -> DataFrame:
    return literal(spark, INPUTS, SPEC)


def viewports(spark: SparkSession) -> DataFrame:
    return literal(spark, VIEWPORTS, "query_id BIGINT, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE")


HELD: list[DataFrame] = []


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, postings and statistics, which a search reads many times; kept in memory or on disk until the next one's, and rebuilt if lost."""
    while HELD:
        HELD.pop().unpersist()
    e = places(spark, sf_dir).persist()
    HELD.extend([e, catalog.postings(e).persist()])
    return e, HELD[-1], catalog.corpus_stats(e)


Q: dict[str, object] = {}
SQL: dict[str, str] = {}
INPUT_SQL = S.values("queries", INPUTS, "query_id, input")
VIEW_SQL = S.values("viewports", VIEWPORTS, "query_id, south, west, north, east")


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Text and catalog


@query("normalize_text", f"SELECT doc_id, {S.norm('text')} AS words FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("words"))


@query("tokenize_explode", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split({S.norm('text')}, ' ')) AS token FROM documents) WHERE length(token) >= 1 GROUP BY token")
def tokenize_explode(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text.normalize(F.col("text")), " ")).alias("token")).where(F.length("token") >= 1)
    per = words.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("entities", f"WITH {S.PLACES} SELECT id, parent_id, kind, n_name, n_address, n_alias, CAST(doc_len AS INTEGER) AS doc_len, address_key, address_context, round(lat, 6) AS lat, round(lng, 6) AS lng FROM entities")
def entities(spark, sf_dir):
    return places(spark, sf_dir).select("id", "parent_id", "kind", "n_name", "n_address", "n_alias", "doc_len", "address_key", "address_context", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("postings_tf", f"WITH {S.CATALOG} SELECT token, id, name_tf, alias_tf, address_tf, kind, closed FROM postings")
def postings_tf(spark, sf_dir):
    return catalog.postings(places(spark, sf_dir)).select("token", "id", "name_tf", "alias_tf", "address_tf", "kind", "closed")


@query("corpus_stats", f"WITH {S.CATALOG} SELECT n_docs, round(avg_doc_len, 9) AS avg_doc_len FROM stats")
def corpus_stats(spark, sf_dir):
    return catalog.corpus_stats(places(spark, sf_dir)).select("n_docs", F.round("avg_doc_len", 9).alias("avg_doc_len"))


@query("document_frequency", f"WITH {S.CATALOG} SELECT token, count(*) AS df FROM postings GROUP BY token")
def document_frequency(spark, sf_dir):
    return catalog.postings(places(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"))


@query("entity_sequence", f"WITH {S.PLACES} SELECT id, row_number() OVER (ORDER BY id) AS seq FROM entities")
def entity_sequence(spark, sf_dir):
    return catalog.numbered(places(spark, sf_dir).select("id"), "id", "seq")


@query("distinct_names", f"WITH {S.PLACES} SELECT n_name, row_number() OVER (ORDER BY n_name) AS name_id FROM (SELECT DISTINCT n_name FROM entities)")
def distinct_names(spark, sf_dir):
    return catalog.numbered(places(spark, sf_dir).select("n_name").distinct(), "n_name", "name_id")


@query("short_prefix_heads", f"""WITH {S.CATALOG}, p AS (
  SELECT prefix, id, 10.0 * sum(name_tf) + 5.0 * sum(alias_tf) + 1.0 * sum(address_tf) AS tf, any_value(kind) AS kind, any_value(doc_len) AS doc_len, any_value(n_name) AS n_name
  FROM (SELECT left(token, 1) AS prefix, * FROM postings UNION ALL SELECT left(token, 2), * FROM postings WHERE length(token) >= 2) WHERE NOT closed GROUP BY prefix, id
), s AS (
  SELECT *, round((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_doc_len)), 9) AS share, CASE WHEN n_name = prefix THEN 0 ELSE 1 END AS e,
    CASE WHEN starts_with(n_name, prefix) THEN 0 ELSE 1 END AS b, {S.KIND_RANK} AS r FROM p, stats
), o AS (SELECT *, row_number() OVER (PARTITION BY prefix, kind = 'street', CASE WHEN kind = 'street' THEN n_name ELSE id END ORDER BY e, b, r, share DESC, id) AS seen FROM s)
SELECT prefix, CAST(rank AS INTEGER) AS rank, id FROM (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY e, b, r, share DESC, id) AS rank, id FROM o WHERE seen = 1) WHERE rank <= 5""")
def short_prefix_heads(spark, sf_dir):
    _, p, s = _catalog(spark, sf_dir)
    return catalog.prefix_heads(p, s)


@query("address_lookup", f"WITH {S.PLACES} SELECT address_key, address_context, id FROM entities WHERE kind = 'address' AND NOT closed AND address_key IS NOT NULL")
def address_lookup(spark, sf_dir):
    return catalog.address_lookup(places(spark, sf_dir)).select("address_key", "address_context", "id")


@query("address_spatial", f"WITH {S.PLACES} SELECT {S.cell('lat', 'lng')} AS cell, id FROM entities WHERE kind = 'address' AND NOT closed")
def address_spatial(spark, sf_dir):
    return catalog.address_cells(places(spark, sf_dir)).select("cell", "id")


# Search


@query("bm25_prefix_and", f"WITH {S.CATALOG}, {INPUT_SQL}, {S.SEARCH} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM hits WHERE rank <= 25")
def bm25_prefix_and(spark, sf_dir):
    _, p, s = _catalog(spark, sf_dir)
    return search.posting_search(inputs(spark), p, s, 25, ascii_only=False)


@query("street_collapse_topk", f"WITH {S.CATALOG}, {INPUT_SQL}, {S.SEARCH} SELECT query_id, n_name, CAST(rank AS INTEGER) AS rank FROM hits JOIN entities USING (id) WHERE kind = 'street' AND rank <= 5")
def street_collapse_topk(spark, sf_dir):
    e, p, s = _catalog(spark, sf_dir)
    return search.posting_search(inputs(spark), p, s, 5).join(e.where("kind = 'street'").select("id", "n_name"), "id").select("query_id", "n_name", "rank")


@query("bm25_topk", """WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM documents),
t AS (SELECT token, doc_id, count(*) AS tf FROM d WHERE token <> '' GROUP BY token, doc_id),
l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
q AS (SELECT * FROM (VALUES ('the'), ('license'), ('of'), ('worthless'), ('version')) v(token)),
f AS (SELECT t.token, count(*) AS df FROM t JOIN q USING (token) GROUP BY t.token),
r AS (SELECT token, doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * ((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score
  FROM t JOIN f USING (token) JOIN l USING (doc_id), s)
SELECT token, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each of some words, over all documents and whole texts."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    tf = read(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("token")).where("token <> ''").groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_doc_len"))
    asked = tf.where(F.col("token").isin("the", "license", "of", "worthless", "version"))
    df = asked.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as words are asked for
    rows = asked.join(F.broadcast(df), "token").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    score = F.round(catalog.bm25(F.col("tf"), F.col("df"), F.col("len"), F.col("n_docs"), F.col("avg_doc_len")), 6)
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "doc_id")))
    return ranked.where("rank <= 10").select("token", "doc_id", "score", "rank")


@query("exact_area_order", f"WITH {S.PLACES}, {INPUT_SQL}, {S.AREAS} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM areas WHERE rank <= 5")
def exact_area_order(spark, sf_dir):
    return search.exact_areas(inputs(spark), places(spark, sf_dir))


MERGED = f"WITH {S.CATALOG}, {INPUT_SQL}, {S.SEARCH}, {S.AREAS}, a5 AS (SELECT * FROM areas WHERE rank <= 5), h5 AS (SELECT * FROM hits WHERE rank <= 5), {S.merged('both_', ['a5', 'h5'], 5)}"


@query("candidate_merge_first", f"{MERGED} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM both_")
def candidate_merge_first(spark, sf_dir):
    e, p, s = _catalog(spark, sf_dir)
    return search.merged_first([search.exact_areas(inputs(spark), e), search.posting_search(inputs(spark), p, s)], 5)


EVIDENCE = """evidence AS (SELECT id, n_name, closed, CASE WHEN confidence >= 0.95 THEN 3 WHEN confidence >= 0.75 THEN 2 WHEN confidence > 0 THEN 1 ELSE 0 END AS tier,
  CASE WHEN class_name <> '' THEN len(string_split(class_name, '_')) ELSE 0 END AS depth,
  CASE class_name WHEN 'cultural_and_historic' THEN 4 WHEN 'arts_and_entertainment' THEN 3 WHEN 'community_and_government' THEN 3 WHEN 'sports_and_recreation' THEN 2 WHEN 'geographic_entities' THEN 1 ELSE 0 END AS class,
  class_name IN ('monument', 'stadium_arena') OR ends_with(class_name, '_stadium') AS override FROM entities WHERE kind = 'business')"""


@query("place_evidence", f"WITH {S.PLACES}, {EVIDENCE} SELECT id, CAST(tier AS INTEGER) AS tier, CAST(depth AS INTEGER) AS depth, CAST(class AS INTEGER) AS class, override FROM evidence")
def place_evidence(spark, sf_dir):
    return search.place_evidence(places(spark, sf_dir)).select("id", "tier", "depth", "class", "override")


SUFFIXES = ", ".join(f"'{s}'" for s in text.STREET_SUFFIXES)


@query("destination_promotion", f"""{MERGED}, {EVIDENCE}, ev AS (SELECT * FROM evidence WHERE NOT closed),
f AS (SELECT b.query_id, q, b.id AS first_id, e.kind AS fk, e.n_name, x.tier AS t0, x.depth AS d0, x.class AS c0 FROM both_ b JOIN entities e USING (id) JOIN asked USING (query_id) LEFT JOIN ev x ON x.id = b.id
  WHERE rank = 1 AND e.n_name = q AND NOT (e.kind = 'street' AND string_split(q, ' ')[-1] IN ({SUFFIXES})) AND NOT (e.kind = 'area' AND {S.AREA_RANK} <= 1)),
c AS (SELECT f.*, x.id, x.tier, x.depth, x.class, x.override, count(*) OVER (PARTITION BY query_id) AS m FROM f JOIN ev x ON x.n_name = f.q),
g AS (SELECT c.*, b.rank AS place FROM c LEFT JOIN both_ b ON b.query_id = c.query_id AND b.id = c.id WHERE m <= 64 AND c.id <> first_id AND CASE fk WHEN 'area' THEN override
  WHEN 'business' THEN coalesce(CASE WHEN c0 = 0 THEN class <> 0 WHEN class = c0 THEN (tier, depth, class) > (t0, d0, c0) ELSE c0 = 1 AND class IN (3, 4) END, false) ELSE class <> 0 END),
best AS (SELECT query_id, 1 AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, depth DESC, class DESC, place ASC NULLS LAST, id) AS nth FROM g) WHERE nth = 1),
{S.merged('final', ['best', 'both_'], 5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM final""")
def destination_promotion(spark, sf_dir):
    e, p, s = _catalog(spark, sf_dir)
    return search.unstructured(inputs(spark), e, p, s)


@query("viewport_rerank", f"""WITH {S.CATALOG}, {INPUT_SQL}, {VIEW_SQL}, {S.SEARCH}, v AS (
  SELECT h.query_id, h.rank, h.id, CASE WHEN n_name = q OR regexp_replace(n_name, '^the ', '') = q THEN 0 WHEN starts_with(n_name, q) OR starts_with(regexp_replace(n_name, '^the ', ''), q) THEN 1 ELSE 2 END AS c,
    {S.inside()} AS inside, round({S.metres('(south + north) / 2', S.centre(), 'lat', 'lng')}, 3) AS metres
  FROM hits h JOIN entities USING (id) JOIN asked USING (query_id) JOIN viewports USING (query_id) WHERE h.rank <= 25)
SELECT query_id, CAST(place AS INTEGER) AS rank, id, inside, metres FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, inside DESC, metres, rank) AS place FROM v) WHERE place <= 5""")
def viewport_rerank(spark, sf_dir):
    e, p, s = _catalog(spark, sf_dir)
    asked = inputs(spark).join(viewports(spark), "query_id")
    return search.viewport_ranked(search.posting_search(inputs(spark), p, s, 25), asked, e)


def _around(key: int) -> tuple[float, float]:
    """Where an address of the places view lies."""
    return 24 + (key + 5000) * 7919 % 26000 / 1000, -125 + (key + 5000) * 104729 % 59000 / 1000


AROUND = [(i, a - 0.5, b - 0.4, a + 0.52, b + 0.42) for i, (a, b) in enumerate(map(_around, range(1, 60, 4)))] + [(99, 24.0, -120.0, 27.0, -119.0)]


@query("viewport_context_knn", f"""WITH {S.PLACES}, {S.values('v', AROUND, 'query_id, south, west, north, east')},
c AS (SELECT query_id, (south + north) / 2 AS a, (west + east) / 2 AS b FROM v WHERE north - south > 0 AND north - south <= 2 AND east - west > 0 AND east - west <= 2),
h AS (SELECT query_id, id, round(pow(lat - a, 2) + pow((lng - b) * cos(radians(a)), 2), 12) AS d FROM c JOIN entities ON kind = 'address' AND NOT closed AND {S.metres('a', 'b', 'lat', 'lng')} <= 5000)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM h) WHERE rank <= 8""")
def viewport_context_knn(spark, sf_dir):
    return search.nearest_addresses(literal(spark, AROUND, "query_id BIGINT, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE"), places(spark, sf_dir))


VIEWED = [(r[0], w) for r, w in zip(AROUND, ["building", "st", "machinery ave", "12", "nation", "furniture", "", "auto", "household rd", "us", "harbor", "zzzz", "lane", "1", "b", "red"], strict=True)]
#: The parts of an address label after the first comma are its locality and region.
ADDRESS_PARTS = "SELECT id, split_part(address, ', ', 2) AS locality, split_part(address, ', ', 3) AS region FROM entities WHERE kind = 'address'"


@query("viewport_context_search", f"""WITH {S.CATALOG}, {S.values('v', AROUND, 'query_id, south, west, north, east')}, {S.values('typed_in', VIEWED, 'query_id, input')}, parts AS ({ADDRESS_PARTS}),
c AS (SELECT query_id, (south + north) / 2 AS a, (west + east) / 2 AS b FROM v WHERE north - south > 0 AND north - south <= 2 AND east - west > 0 AND east - west <= 2),
d AS (SELECT query_id, id, {S.metres('a', 'b', 'lat', 'lng')} AS m, round(pow(lat - a, 2) + pow((lng - b) * cos(radians(a)), 2), 12) AS d FROM c JOIN entities ON kind = 'address' AND NOT closed AND {S.metres('a', 'b', 'lat', 'lng')} <= 5000),
n AS (SELECT query_id, round(m, 6) AS m, id, {S.norm('locality')} AS l, {S.norm('region')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d) JOIN parts USING (id) WHERE rank <= 8),
x AS (SELECT query_id, l || ' ' || r AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, id) AS nth FROM n WHERE l <> '' AND r <> '') WHERE nth = 1),
queries AS (SELECT query_id * 2 AS query_id, {S.norm('input')} || ' ' || context AS input FROM typed_in JOIN x USING (query_id) WHERE {S.norm('input')} <> '' UNION ALL SELECT query_id * 2 + 1, input FROM typed_in), {S.SEARCH},
h0 AS (SELECT query_id // 2 AS query_id, rank, id FROM hits WHERE query_id % 2 = 0 AND rank <= 25), h1 AS (SELECT query_id // 2 AS query_id, rank, id FROM hits WHERE query_id % 2 = 1 AND rank <= 5),
{S.merged('seen_first', ['h0', 'h1'], 30)} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM seen_first""")
def viewport_context_search(spark, sf_dir):
    """What is typed, searched with the locality and region around the viewport and then without them."""
    e, p, s = _catalog(spark, sf_dir)
    views = literal(spark, AROUND, "query_id BIGINT, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE")
    words = search.viewport_words(views, e, spark.sql(ADDRESS_PARTS.replace("FROM entities", "FROM {entities}"), entities=e))
    return search.search_in_view(literal(spark, VIEWED, SPEC), words, p, s, ascii_only=True)


CLOSURE = f"closure AS (SELECT id, ancestor FROM (SELECT id, parent_id AS ancestor FROM entities WHERE parent_id IS NOT NULL UNION SELECT a.id, b.parent_id FROM entities a JOIN entities b ON a.parent_id = b.id WHERE b.parent_id IS NOT NULL UNION SELECT a.id, c.parent_id FROM entities a JOIN entities b ON a.parent_id = b.id JOIN entities c ON b.parent_id = c.id WHERE c.parent_id IS NOT NULL))"


@query("ancestor_closure", f"WITH {S.PLACES}, {CLOSURE} SELECT id, ancestor FROM closure")
def ancestor_closure(spark, sf_dir):
    return search.ancestors(places(spark, sf_dir).select("id", "parent_id"))


@query("descendant_semi", f"WITH {S.PLACES}, {CLOSURE} SELECT kind, count(*) AS n FROM entities WHERE id IN (SELECT id FROM closure WHERE ancestor IN (SELECT id FROM entities WHERE n_name = 'asia')) GROUP BY kind")
def descendant_semi(spark, sf_dir):
    e = places(spark, sf_dir)
    top = e.where("n_name = 'asia'").select(F.col("id").alias("ancestor"))
    under = search.ancestors(e.select("id", "parent_id")).join(top, "ancestor", "left_semi")
    return e.join(under, "id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@query("parse_context", f"""WITH {S.values('queries', CONTEXTS, 'query_id, input')}, p AS (SELECT query_id, list_transform(string_split(input, ','), lambda x: trim(x)) AS parts FROM queries),
n AS (SELECT *, {S.norm('parts[1]')} AS a, {S.norm("coalesce(parts[2], '')")} AS b, {S.norm('parts[-1]')} AS r0 FROM p),
m AS (SELECT *, coalesce((SELECT {S.CODES} FROM (SELECT r0 AS r)), (SELECT {S.CODES} FROM (SELECT replace(r0, ' ', '') AS r))) AS code FROM n),
f AS (SELECT query_id, parts, code, a, b, CASE WHEN len(parts) = 2 AND trim(string_split(lower(parts[1]), ' ')[1], '.') = 'st' AND starts_with(a, 'street ') THEN 'saint ' || substr(a, 8) ELSE a END AS name,
  CASE WHEN len(parts) = 3 THEN CASE WHEN trim(string_split(lower(parts[2]), ' ')[1], '.') = 'st' AND starts_with(b, 'street ') THEN 'saint ' || substr(b, 8) ELSE b END END AS locality FROM m)
SELECT query_id, name, locality, code AS region_code FROM f WHERE len(parts) IN (2, 3) AND NOT list_contains(parts, '') AND code IS NOT NULL AND name <> '' AND regexp_matches(parts[1], '\\p{{L}}')
  AND (len(parts) = 2 OR (locality <> '' AND regexp_matches(parts[2], '\\p{{L}}')))""")
def parse_context(spark, sf_dir):
    return search.parsed_context(literal(spark, CONTEXTS, SPEC))


IN_REGION = [(i, f"saint nation {i % 7}", r) for i, r in enumerate(["africa", "america", "asia", "europe", "middle east"] * 4, 1)]


@query("context_city_state", f"""WITH {S.PLACES}, {CLOSURE}, {S.values('queries', IN_REGION, 'query_id, name, region')},
h AS (SELECT query_id, p.id, p.prominence, p.subtype FROM queries q JOIN entities r ON r.kind = 'area' AND r.subtype = 'region' AND r.n_name = q.region JOIN entities p ON p.kind = 'area' AND NOT p.closed AND p.n_name = q.name
  WHERE p.subtype IN ('locality', 'macrohood', 'neighborhood') AND EXISTS (SELECT 1 FROM closure c WHERE c.id = p.id AND c.ancestor = r.id))
SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {S.AREA_RANK}, prominence DESC, id) AS rank FROM h) WHERE rank <= 5""")
def context_city_state(spark, sf_dir):
    e = places(spark, sf_dir)
    asked = literal(spark, IN_REGION, "query_id BIGINT, name STRING, region STRING")
    return search.in_context(asked, e, search.ancestors(e.where("kind = 'area'").select("id", "parent_id")))


ANCHORS = [(i, f"{c} {n} {s}", 24.0 + i, -120.0 + 3 * i) for i, (c, n, s) in enumerate([("red", "widget", "street"), ("small", "ring", "avenue"), ("blue", "bolt", "road"), ("large", "gear", "street"), ("green", "widget", "road"), ("red", "ring", "street")] * 3, 1)]


@query("context_street_near", f"""WITH {S.PLACES}, {S.values('anchors', ANCHORS, 'query_id, name, a, b')},
h AS (SELECT query_id, e.id, round({S.metres('a', 'b', 'lat', 'lng')}, 3) AS metres FROM anchors JOIN entities e ON e.kind = 'street' AND NOT closed AND n_name = anchors.name)
SELECT query_id, id, metres FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN metres <= 500000 THEN 0 ELSE 1 END, CASE WHEN metres <= 500000 THEN 0 ELSE metres END, id) AS nth FROM h WHERE metres <= 2000000) WHERE nth = 1""")
def context_street_near(spark, sf_dir):
    anchors = literal(spark, ANCHORS, "query_id BIGINT, name STRING, lat DOUBLE, lng DOUBLE")
    return search.street_near(anchors, places(spark, sf_dir), 500_000.0, 2_000_000.0)


@query("fuzzy_terms", f"""WITH {S.CATALOG}, {S.values('queries', [(1, 'harbr markt'), (2, 'machinry'), (3, 'widgit rng'), (4, 'natoin'), (5, 'supplir')], 'query_id, input')}, df AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
w AS (SELECT query_id, unnest(string_split(input, ' ')) AS word, generate_subscripts(string_split(input, ' '), 1) - 1 AS pos FROM queries),
h AS (SELECT query_id, pos, word, token, df, row_number() OVER (PARTITION BY query_id, pos ORDER BY df DESC, token) AS nth FROM w JOIN df ON left(word, 2) = left(token, 2) AND length(word) >= 4 AND abs(length(token) - length(word)) <= 2),
e AS (SELECT *, levenshtein(word, token) AS edits FROM h WHERE nth <= 256)
SELECT query_id, CAST(pos AS INTEGER) AS pos, term, CAST(edits AS INTEGER) AS edits FROM (SELECT query_id, pos, token AS term, edits, row_number() OVER (PARTITION BY query_id, pos ORDER BY edits, df DESC, token) AS k FROM e WHERE edits <= 2) WHERE k <= 8""")
def fuzzy_terms(spark, sf_dir):
    words = search.query_words(literal(spark, [(1, "harbr markt"), (2, "machinry"), (3, "widgit rng"), (4, "natoin"), (5, "supplir")], SPEC))
    tokens = catalog.postings(places(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"))
    return search.fuzzy_terms(words, tokens)


@query("gauss_decay_score", f"""WITH {S.PLACES}, {VIEW_SQL}, d AS (SELECT query_id, id, {S.metres('(south + north) / 2', S.centre(), 'lat', 'lng')} AS m, least(1000000.0, greatest(2000.0, {S.metres('south', 'west', 'north', 'east')} / 2)) AS s
  FROM viewports JOIN entities ON kind = 'area') SELECT query_id, id, round(exp(ln(0.5) * pow(m / s, 2)) * 40.0, 6) AS score FROM d""")
def gauss_decay_score(spark, sf_dir):
    """Every area against a handful of viewports, which are the stated query set."""
    areas = places(spark, sf_dir).where("kind = 'area'").select("id", "lat", "lng")
    v = viewports(spark)
    rows = areas.crossJoin(F.broadcast(v))  # as many rows as VIEWPORTS has
    away = geo.distance((F.col("south") + F.col("north")) / 2, geo.centre_lng(F.col("west"), F.col("east")), F.col("lat"), F.col("lng"))
    scale = geo.viewport_scale(F.col("south"), F.col("west"), F.col("north"), F.col("east"))
    return rows.select("query_id", "id", F.round(geo.gaussian_decay(away, scale, 40.0), 6).alias("score"))


FUNCTION = "CASE kind WHEN 'area' THEN 10.0 ELSE 0.0 END + CASE subtype WHEN 'region' THEN 80.0 ELSE 0.0 END + prominence * 1.5 + CASE class_name WHEN 'city' THEN 4 WHEN 'town' THEN 3 WHEN 'village' THEN 2 WHEN 'hamlet' THEN 1 ELSE 0 END * 6.0 + CASE kind WHEN 'street' THEN 80.0 ELSE 0.0 END + floor(confidence * 4) * 2.0"


@query("function_score", f"WITH {S.PLACES} SELECT id, round(least(500.0, {FUNCTION}), 6) AS boost FROM entities")
def function_score(spark, sf_dir):
    return places(spark, sf_dir).select("id", F.round(F.least(F.lit(500.0), F.expr(FUNCTION).cast("double")), 6).alias("boost"))


@query("candidate_merge_max", f"""WITH {S.PLACES}, {VIEW_SQL}, n AS (SELECT query_id, id, round(1000 - prominence, 6) AS score FROM viewports JOIN entities ON kind = 'area'),
l AS (SELECT query_id, id, round(1100.0 - {S.metres('(south + north) / 2', S.centre(), 'lat', 'lng')} / 10000, 6) AS score FROM viewports JOIN entities ON kind = 'area' AND {S.inside()})
SELECT query_id, id, max(score) AS score FROM (SELECT * FROM n UNION ALL SELECT * FROM l) GROUP BY query_id, id""")
def candidate_merge_max(spark, sf_dir):
    rows = places(spark, sf_dir).where("kind = 'area'").crossJoin(F.broadcast(viewports(spark)))  # as many rows as VIEWPORTS has
    away = geo.distance((F.col("south") + F.col("north")) / 2, geo.centre_lng(F.col("west"), F.col("east")), F.col("lat"), F.col("lng"))
    wide = rows.select("query_id", "id", F.round(1000.0 - F.col("prominence"), 6).alias("score"))
    local = rows.where(geo.contains(F.col("south"), F.col("west"), F.col("north"), F.col("east"), F.col("lat"), F.col("lng"))).select("query_id", "id", F.round(1100.0 - away / 10_000, 6).alias("score"))
    return search.merged_best([wide, local])


# Geocoding

#: The literal inputs, and every customer's own address as an input.
OWN_ADDRESSES = f"SELECT c_custkey AS query_id, {SOURCES['customer'][4]} AS input FROM customer"
ADDRESS_SQL = S.values("literals", [(-i, x) for i, x in ADDRESSES], "query_id, input") + f", queries AS (SELECT * FROM literals UNION ALL {OWN_ADDRESSES})"
UNIT = r"(?i)(#|\b(apt|apartment|unit|suite|ste|floor|fl|room)\b)"
FORWARD = f"""g AS (SELECT query_id, CASE WHEN input IS NULL OR trim(input) = '' OR length(input) > 200 THEN 'invalid_input' WHEN regexp_matches(input, '{UNIT}') THEN 'unsupported_input'
    WHEN {S.address_key("string_split(input, ',')[1]")} IS NULL THEN 'unsupported_input' ELSE 'ok' END AS grammar, {S.address_key("string_split(input, ',')[1]")} AS k,
  trim(replace(replace(replace(' ' || {S.norm("array_to_string(string_split(input, ',')[2:], ' ')")} || ' ', ' rhode island ', ' ri '), ' united states ', ' us '), ' usa ', ' us ')) AS wanted FROM queries),
h AS (SELECT query_id, id FROM g JOIN entities e ON grammar = 'ok' AND e.address_key = g.k AND e.kind = 'address' AND NOT closed
  WHERE wanted = '' OR regexp_matches(' ' || address_context || ' ', ' ' || replace(wanted, ' ', ' (.* )?') || ' ')),
m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM h),
found AS (SELECT g.query_id, CASE WHEN grammar <> 'ok' THEN grammar WHEN m IS NULL THEN 'no_match' WHEN m = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, id FROM g LEFT JOIN m USING (query_id))"""


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(OWN_ADDRESSES.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))
    return own.unionAll(literal(spark, [(-i, x) for i, x in ADDRESSES], SPEC))


@query("forward_geocode", f"WITH {S.PLACES}, {ADDRESS_SQL}, {FORWARD} SELECT query_id, outcome, id FROM found")
def forward_geocode(spark, sf_dir):
    return geocode.forward(_addresses(spark, sf_dir), catalog.address_lookup(places(spark, sf_dir)), ascii_only=True)


@query("forward_biased", f"""WITH {S.PLACES}, {ADDRESS_SQL}, {FORWARD}, {VIEW_SQL}, b AS (SELECT query_id, id, {S.inside()} AS inside, round({S.metres('(south + north) / 2', S.centre(), 'lat', 'lng')}, 3) AS metres
  FROM found JOIN entities USING (id) JOIN viewports USING (query_id)) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, metres, id) AS INTEGER) AS rank, id FROM b""")
def forward_biased(spark, sf_dir):
    e = places(spark, sf_dir)
    return geocode.biased(geocode.forward(_addresses(spark, sf_dir), catalog.address_lookup(e), ascii_only=True), viewports(spark), e)


@query("address_key_parse", f"SELECT p_partkey, {S.address_key('raw')} AS address_key FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '00' ELSE '' END || p_size || CASE p_partkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN '-2' ELSE '' END || ' ' || p_name || ' Blvd.' AS raw FROM part)")
def address_key_parse(spark, sf_dir):
    raw = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN '00' ELSE '' END, p_size, CASE p_partkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN '-2' ELSE '' END, ' ', p_name, ' Blvd.')")
    return read(spark, sf_dir, "part").select("p_partkey", text.address_key(raw, ascii_only=True).alias("address_key"))


NEARBY = "SELECT c_custkey AS query_id, 24 + CAST((c_custkey + 5000) * 7919 % 26000 AS DOUBLE) / 1000 + CAST(c_custkey % 5 AS DOUBLE) * 0.0004 AS lat, -125 + CAST((c_custkey + 5000) * 104729 % 59000 AS DOUBLE) / 1000 AS lng FROM customer"
REVERSE = f"""asked AS ({NEARBY} UNION ALL SELECT * FROM points), g AS (SELECT *, CASE WHEN NOT coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false) THEN 'invalid_input'
  WHEN NOT (lat BETWEEN 24 AND 50 AND lng BETWEEN -125 AND -66) THEN 'outside_coverage' ELSE 'ok' END AS grammar FROM asked),
cells AS (SELECT id, lat, lng, {S.cell('lat', 'lng')} AS cell FROM entities WHERE kind = 'address' AND NOT closed),
near AS (SELECT query_id, lat, lng, unnest(flatten(list_transform([-1, 0, 1], lambda y: list_transform([-2, -1, 0, 1, 2], lambda x: {S.cell('lat', 'lng')} + y * 360001 + x)))) AS cell FROM g WHERE grammar = 'ok'),
h AS (SELECT query_id, c.id, {S.metres('n.lat', 'n.lng', 'c.lat', 'c.lng')} AS metres FROM near n JOIN cells c USING (cell)),
r AS (SELECT *, min(metres) OVER (PARTITION BY query_id) AS least FROM h WHERE metres <= 100),
found AS (SELECT g.query_id, CASE WHEN grammar <> 'ok' THEN grammar WHEN id IS NULL THEN 'no_match' ELSE 'matched' END AS outcome, id, round(metres, 3) AS metres
  FROM g LEFT JOIN (SELECT * FROM r WHERE metres <= least + 0.001) USING (query_id))"""
POINT_SQL = S.values("points", [(i - 100, a, b) for i, a, b in POINTS], "query_id, lat, lng")


def _asked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = literal(spark, [(i - 100, a, b) for i, a, b in POINTS], "query_id BIGINT, lat DOUBLE, lng DOUBLE")
    return spark.sql(NEARBY.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")).unionAll(points)


@query("reverse_geocode_grid", f"WITH {S.PLACES}, {POINT_SQL}, {REVERSE} SELECT query_id, outcome, id, metres FROM found")
def reverse_geocode_grid(spark, sf_dir):
    return geocode.reverse(_asked_points(spark, sf_dir), catalog.address_cells(places(spark, sf_dir)), BOUNDS)


@query("reverse_ties", f"WITH {S.PLACES}, {POINT_SQL}, {REVERSE} SELECT outcome, count(*) AS rows_, count(DISTINCT query_id) AS queries_ FROM found GROUP BY outcome")
def reverse_ties(spark, sf_dir):
    found = geocode.reverse(_asked_points(spark, sf_dir), catalog.address_cells(places(spark, sf_dir)), BOUNDS)
    return found.groupBy("outcome").agg(F.count("*").alias("rows_"), F.count_distinct("query_id").alias("queries_"))


COMPONENTS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'other' ELSE 'overture:address' END AS source, concat(c_custkey % 90, ' ', c_mktsegment) AS name, concat(c_custkey % 90, ' ', c_mktsegment, ', RI, Newport, 02840, ', CASE c_custkey % 7 WHEN 0 THEN 'CA' ELSE 'US' END) AS formatted, CAST(c_custkey % 90 AS STRING) AS number, c_mktsegment AS street, CASE c_custkey % 7 WHEN 0 THEN 'CA' ELSE 'US' END AS country, '02840' AS postcode FROM customer"


@query("address_components", f"WITH c AS ({COMPONENTS}) SELECT c_custkey, CASE WHEN source = 'overture:address' THEN number END AS number, CASE WHEN source = 'overture:address' AND country = 'US' THEN 'RI' END AS region, CASE WHEN source = 'overture:address' AND country = 'US' THEN 'Newport' END AS locality, CASE WHEN source = 'overture:address' THEN postcode END AS postcode FROM c")
def address_components(spark, sf_dir):
    rows = spark.sql(COMPONENTS.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")).withColumn("levels", F.array(F.lit("RI"), F.lit("Newport")))
    return geocode.components(rows).select("c_custkey", "number", "region", "locality", "postcode")


@query("details", f"WITH {S.PLACES}, {S.values('asked', [('customer:7',), ('nation:3',), ('part:11',), ('none:1',)], 'k')}, i AS (SELECT {S.public_id('k')} AS id FROM asked) SELECT i.id, kind, n_name FROM i LEFT JOIN entities USING (id)")
def details(spark, sf_dir):
    ids = literal(spark, [("customer:7",), ("nation:3",), ("part:11",), ("none:1",)], "k STRING").select(text.public_id(F.col("k")).alias("id"))
    return geocode.details(ids, places(spark, sf_dir)).select("id", "kind", "n_name")
