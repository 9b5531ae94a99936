"""Queries over records: identity, resolution, links, ingest rules, generations, checks, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geo, text
from plumbline.operators import catalog, generation, ingest, integrity, resolve, search
from plumbline.plans import sql as S
from plumbline.plans.lookup import INPUT_SQL, inputs, places, query
from plumbline.sources.places_view import read

RECORDS = "SELECT concat('order:', o_orderkey) AS source_key, o_custkey AS custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderstatus AS status, CAST(o_orderkey % 9 AS INT) AS gap, CAST(o_orderkey % 4 AS INT) AS who, o_orderkey FROM orders"
IDENTITIES = "SELECT concat('order:', o_orderkey) AS source_key, concat('customer:', o_custkey) AS target FROM orders WHERE o_orderkey % 3 <> 0"


def _records(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    of = lambda q: spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=orders)
    return resolve.anchored(of(RECORDS), of(IDENTITIES))


ANCHORED = f"records AS ({RECORDS}), identities AS ({IDENTITIES}), anchored AS (SELECT r.*, {S.public_id('coalesce(target, source_key)')} AS entity_id FROM records r LEFT JOIN identities USING (source_key))"


@query("identity_sha256", f"WITH {ANCHORED} SELECT source_key, entity_id FROM anchored")
def identity_sha256(spark, sf_dir):
    return _records(spark, sf_dir).select("source_key", "entity_id")


ATTRIBUTES = "CASE WHEN gap = 0 THEN '' WHEN gap = 1 THEN '[]' ELSE status END"


@query("attribute_resolution", f"""WITH {ANCHORED}, a AS (SELECT entity_id, source_key, priority, 'status' AS attribute, {ATTRIBUTES} AS value FROM anchored UNION ALL SELECT entity_id, source_key, priority, 'closed', CASE WHEN gap < 5 THEN NULL ELSE 'false' END FROM anchored),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY priority DESC, source_key) AS nth FROM a WHERE value IS NOT NULL AND value NOT IN ('', 'null', '""', '[]'))
SELECT entity_id, attribute, value, source_key FROM r WHERE nth = 1""")
def attribute_resolution(spark, sf_dir):
    r = _records(spark, sf_dir)
    pairs = F.array(F.struct(F.lit("status").alias("attribute"), F.expr(ATTRIBUTES).alias("value")), F.struct(F.lit("closed").alias("attribute"), F.expr("CASE WHEN gap < 5 THEN NULL ELSE 'false' END").alias("value")))
    return resolve.resolved(r.select("entity_id", "source_key", "priority", F.explode(pairs).alias("p")).select("entity_id", "source_key", "priority", "p.attribute", "p.value"))


@query("attribution_union", f"""WITH {ANCHORED}, f AS (SELECT entity_id, concat('provider ', who) AS provider, row_number() OVER (PARTITION BY entity_id, who ORDER BY -priority, source_key) AS k, priority, source_key FROM anchored)
SELECT entity_id, string_agg(provider, ',' ORDER BY -priority, source_key) AS providers FROM f WHERE k = 1 GROUP BY entity_id""")
def attribution_union(spark, sf_dir):
    return resolve.attribution_union(_records(spark, sf_dir).withColumn("provider", F.concat(F.lit("provider "), F.col("who"))))


EDGES = "SELECT concat('supplier:', l_suppkey) AS \"from\", concat('part:', l_partkey) AS \"to\", CASE l_linenumber % 2 WHEN 0 THEN 'address' ELSE 'parent_area' END AS kind, concat('line ', l_linenumber) AS evidence FROM lineitem"


def _edges(spark, sf_dir):
    return spark.sql(EDGES.replace('"from"', "`from`").replace('"to"', "`to`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


@query("relationship_dedup", f"WITH e AS ({EDGES}) SELECT \"from\" AS from_id, \"to\" AS to_id, kind, min(evidence) AS evidence FROM e GROUP BY ALL")
def relationship_dedup(spark, sf_dir):
    return resolve.distinct_relationships(_edges(spark, sf_dir).withColumnsRenamed({"from": "from_id", "to": "to_id"}))


@query("relationship_endpoints", f"WITH {S.PLACES}, e AS (SELECT DISTINCT * FROM ({EDGES})) SELECT a.id AS from_id, b.id AS to_id, e.kind, evidence FROM e LEFT JOIN entities a ON a.key = \"from\" LEFT JOIN entities b ON b.key = \"to\"")
def relationship_endpoints(spark, sf_dir):
    keys = places(spark, sf_dir).select(F.col("key").alias("source_key"), F.col("id").alias("entity_id"))
    return resolve.resolved_endpoints(_edges(spark, sf_dir).distinct(), keys)


LINKS = "SELECT concat('{t}:', {k}) AS source_key, concat({k} % 20, ' main st') AS label, concat('028', {k} % 3) AS postcode, 41 + CAST({k} % 40 AS DOUBLE) / 20000 AS lat, -71 + CAST({k} % 7 AS DOUBLE) / 9000 AS lng FROM {f}"
B_SQL, A_SQL = LINKS.format(t="supplier", k="s_suppkey", f="supplier"), LINKS.format(t="customer", k="c_custkey", f="customer")


@query("unique_link_50m", f"""WITH b AS ({B_SQL}), a AS ({A_SQL}), m AS (SELECT b.source_key, count(*) AS matches, min(a.source_key) AS one FROM b JOIN a ON a.label = b.label AND a.postcode = b.postcode AND {S.metres('b.lat', 'b.lng', 'a.lat', 'a.lng')} <= 50 GROUP BY b.source_key)
SELECT source_key, matches, CASE WHEN matches = 1 THEN one END AS address_key FROM m""")
def unique_link_50m(spark, sf_dir):
    b = spark.sql(B_SQL.replace("FROM supplier", "FROM {t}"), t=read(spark, sf_dir, "supplier"))
    a = spark.sql(A_SQL.replace("FROM customer", "FROM {t}"), t=read(spark, sf_dir, "customer"))
    return resolve.unique_links(b, a)


# Ingest rules

FEATURES = """SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'segment' WHEN 1 THEN 'place' WHEN 2 THEN 'address' ELSE 'division' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN 'rail' ELSE 'road' END AS subtype, CASE WHEN p_size % 7 = 0 THEN ' ' WHEN p_size % 11 = 0 THEN '...' ELSE p_name END AS name,
  CASE WHEN p_size % 6 = 0 THEN '' ELSE concat(p_size, ' ', p_name) END AS label, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'CA' ELSE 'US' END AS country,
  CASE WHEN p_partkey % 9 = 0 THEN 'MA' ELSE 'RI' END AS region, 40 + CAST(p_partkey % 50 AS DOUBLE) / 10 AS lat, -73 + CAST(p_partkey % 37 AS DOUBLE) / 10 AS lng FROM part"""
BOXES = [(-72.0, 41.0, -71.0, 42.5), (-70.5, 40.0, -69.5, 44.0)]
BOX_SQL = " OR ".join(f"(lng BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n})" for w, s, e, n in BOXES)
SCOPE_SQL = f"({BOX_SQL}) AND CASE WHEN kind = 'place' THEN coalesce(country, '') IN ('', 'US') ELSE coalesce(country = 'US', false) END AND (kind = 'division' OR region = 'RI')"


def _features(spark, sf_dir):
    rows = spark.sql(FEATURES.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))
    inside = ingest.in_boxes(F.col("lat"), F.col("lng"), BOXES)
    rows = rows.withColumns({"inside": inside, "scoped": ingest.in_scope(F.col("kind"), F.col("country"), F.col("region"), inside, ["RI"])})
    shown = F.when(F.col("kind") == "address", F.col("label")).otherwise(F.col("name"))
    return rows.withColumn("search_text", text.normalize(shown, ascii_only=True))


@query("reject_reasons", f"""WITH f AS (SELECT *, {S.norm("CASE WHEN kind = 'address' THEN label ELSE name END")} AS t FROM ({FEATURES}))
SELECT p_partkey, CASE WHEN kind = 'segment' AND subtype <> 'road' THEN 'non_road_segment' WHEN kind = 'segment' AND trim(name) = '' THEN 'missing_primary_name' WHEN kind = 'segment' AND NOT ({BOX_SQL}) THEN 'outside_manifest_geometry'
  WHEN kind <> 'segment' AND NOT ({SCOPE_SQL}) THEN 'outside_configured_scope' WHEN kind = 'address' AND trim(label) = '' OR kind = 'place' AND trim(name) = '' THEN 'missing_display_name' WHEN t = '' THEN 'missing_search_text' END AS reason FROM f""")
def reject_reasons(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return rows.select("p_partkey", ingest.reject_reason(rows).alias("reason"))


@query("scope_filter", f"SELECT p_partkey, kind FROM ({FEATURES}) WHERE {SCOPE_SQL}")
def scope_filter(spark, sf_dir):
    return _features(spark, sf_dir).where("scoped").select("p_partkey", "kind")


@query("bbox_overlap", f"SELECT p_partkey FROM ({FEATURES}) WHERE " + " OR ".join(f"(lng - 0.2 < {e} AND lng + 0.3 > {w} AND lat - 0.1 < {n} AND lat + 0.4 > {s})" for w, s, e, n in BOXES))
def bbox_overlap(spark, sf_dir):
    box = F.struct((F.col("lng") - 0.2).alias("xmin"), (F.col("lng") + 0.3).alias("xmax"), (F.col("lat") - 0.1).alias("ymin"), (F.col("lat") + 0.4).alias("ymax"))
    return _features(spark, sf_dir).withColumn("bbox", box).where(ingest.overlaps("bbox", BOXES)).select("p_partkey")


LINE = "SELECT p_partkey AS id, -72.5 + CAST(p_partkey % 30 AS DOUBLE) / 20 AS x1, 40.5 + CAST(p_partkey % 41 AS DOUBLE) / 20 AS y1, -72.5 + CAST(p_partkey % 23 AS DOUBLE) / 10 AS x2, 40.5 + CAST(p_partkey % 29 AS DOUBLE) / 15 AS y2 FROM part"
W_, S_, E_, N_ = BOXES[0]
CLIP_SQL = f"""c AS (SELECT id, x1, y1, x2, y2, x2 - x1 AS dx, y2 - y1 AS dy FROM ({LINE})), d AS (SELECT *,
  CASE WHEN dx = 0 THEN CASE WHEN x1 < {W_} OR x1 > {E_} THEN 2.0 ELSE 0.0 END ELSE least(({W_} - x1) / dx, ({E_} - x1) / dx) END AS a0, CASE WHEN dx = 0 THEN CASE WHEN x1 < {W_} OR x1 > {E_} THEN -1.0 ELSE 1.0 END ELSE greatest(({W_} - x1) / dx, ({E_} - x1) / dx) END AS a1,
  CASE WHEN dy = 0 THEN CASE WHEN y1 < {S_} OR y1 > {N_} THEN 2.0 ELSE 0.0 END ELSE least(({S_} - y1) / dy, ({N_} - y1) / dy) END AS b0, CASE WHEN dy = 0 THEN CASE WHEN y1 < {S_} OR y1 > {N_} THEN -1.0 ELSE 1.0 END ELSE greatest(({S_} - y1) / dy, ({N_} - y1) / dy) END AS b1 FROM c),
t AS (SELECT id, x1, y1, x2, y2, greatest(0.0, a0, b0) AS t0, least(1.0, a1, b1) AS t1 FROM d)"""


def _lines(spark, sf_dir):
    return spark.sql(LINE.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))


@query("liang_barsky_clip", f"WITH {CLIP_SQL} SELECT id, round(t0, 9) + 0 AS t0, round(t1, 9) + 0 AS t1 FROM t WHERE t0 <= t1")
def liang_barsky_clip(spark, sf_dir):
    part = geo.clip(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), BOXES[0])
    return _lines(spark, sf_dir).withColumn("c", part).where("c is not null").select("id", (F.round("c.t0", 9) + 0).alias("t0"), (F.round("c.t1", 9) + 0).alias("t1"))


@query("midpoint_along_line", f"WITH {CLIP_SQL} SELECT id, round((y1 + (y2 - y1) * t0 + y1 + (y2 - y1) * t1) / 2, 6) AS lat, round((x1 + (x2 - x1) * t0 + x1 + (x2 - x1) * t1) / 2, 6) AS lng FROM t WHERE t0 <= t1")
def midpoint_along_line(spark, sf_dir):
    """Lines of one edge, whose midpoint is that of the clipped edge; tests have longer ones."""
    ends = F.array(F.struct(F.col("y1").alias("lat"), F.col("x1").alias("lng")), F.struct(F.col("y2").alias("lat"), F.col("x2").alias("lng")))
    found = ingest.midpoints(_lines(spark, sf_dir).select("id", ends.alias("points")), [BOXES[0]])
    return found.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


RING = [(-72.5, 40.0), (-70.0, 40.5), (-71.0, 41.5), (-69.8, 43.0), (-72.0, 44.0)]
CROSS = " + ".join(
    f"CASE WHEN ({a[1]}e0 > lat) <> ({b[1]}e0 > lat) AND lng < ({b[0]}e0 - ({a[0]}e0)) * (lat - {a[1]}e0) / ({b[1]}e0 - {a[1]}e0) + ({a[0]}e0) THEN 1 ELSE 0 END"
    for a, b in zip(RING, RING[1:] + RING[:1], strict=True)
)


@query("point_in_polygon", f"SELECT p_partkey, ({CROSS}) % 2 = 1 AS inside FROM ({FEATURES})")
def point_in_polygon(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return _features(spark, sf_dir).select("p_partkey", geo.in_ring(F.col("lng"), F.col("lat"), ring).alias("inside"))


# Generations and checks

OLD = "SELECT concat('order:', o_orderkey) AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 50 = 1 THEN 0 ELSE o_custkey END AS cust FROM orders WHERE o_orderkey % 10 <> 0"
NEW = "SELECT concat('order:', o_orderkey) AS id, CASE WHEN o_orderkey % 40 = 3 THEN 'X' ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders WHERE o_orderkey % 10 <> 7"


def _generations(spark, sf_dir):
    return tuple(spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders")) for q in (OLD, NEW))


@query("generation_diff_full_outer", f"""SELECT count(*) FILTER (WHERE a.id IS NULL) AS added, count(*) FILTER (WHERE b.id IS NULL) AS removed, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS kept,
  count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND (a.status IS DISTINCT FROM b.status OR a.cust IS DISTINCT FROM b.cust)) AS changed FROM ({OLD}) a FULL OUTER JOIN ({NEW}) b ON a.id = b.id""")
def generation_diff_full_outer(spark, sf_dir):
    return generation.compared(*_generations(spark, sf_dir), ["status", "cust"])


@query("relationship_except", f"(SELECT *, 'added' AS change FROM (({NEW}) EXCEPT ({OLD}))) UNION ALL (SELECT *, 'removed' FROM (({OLD}) EXCEPT ({NEW})))")
def relationship_except(spark, sf_dir):
    return generation.changed_rows(*_generations(spark, sf_dir))


@query("integrity_duplicates", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def integrity_duplicates(spark, sf_dir):
    return resolve.duplicates(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


CHECKS = """SELECT 'lines_without_order' AS "check", count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'orders_without_customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'names_too_long', count(*) FROM part WHERE length(p_name) > 200"""


@query("integrity_anti", CHECKS)
def integrity_anti(spark, sf_dir):
    orders, lines, customers = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return resolve.violations({
        "lines_without_order": lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_anti"),
        "orders_without_lines": orders.join(lines, lines["l_orderkey"] == orders["o_orderkey"], "left_anti"),
        "orders_without_customer": orders.join(customers, customers["c_custkey"] == orders["o_custkey"], "left_anti"),
        "names_too_long": read(spark, sf_dir, "part").where(F.length("p_name") > 200),
    })


#: A copy of the catalog with faults of each kind, which the checks have to count.
DAMAGED = {
    "e": """SELECT id, CASE WHEN k % 271 = 15 THEN repeat('x', 201) ELSE name END AS name, n_name, n_alias, n_address, closed, lng, CASE WHEN k % 277 <> 16 THEN address_key END AS address_key, CASE WHEN k % 211 = 4 THEN '' ELSE key END AS key, CASE WHEN k % 223 = 5 THEN 'thing' ELSE kind END AS kind, CASE WHEN k % 227 = 6 THEN 91.5 ELSE lat END AS lat,
  CASE WHEN k % 229 = 7 THEN 1000 ELSE prominence END AS prominence, CASE WHEN k % 233 = 8 THEN NULL ELSE confidence END AS confidence, CASE WHEN k % 239 = 9 THEN doc_len + 1 ELSE doc_len END AS doc_len,
  CASE WHEN k % 241 = 10 THEN concat('lost', id) WHEN k % 251 = 11 THEN id ELSE parent_id END AS parent_id FROM entities WHERE k % 257 <> 12 UNION ALL
  SELECT id, name, '' AS n_name, n_alias, n_address, closed, lng, address_key, key, kind, lat, prominence, confidence, doc_len, parent_id FROM entities WHERE k % 263 = 13""",
    "p": """SELECT token, id, name_tf, alias_tf, address_tf, kind, NOT closed AS closed, doc_len, n_name FROM postings WHERE doc_len % 7 = 6 UNION ALL SELECT token, id, name_tf, alias_tf, address_tf, kind, closed, doc_len, n_name FROM postings WHERE doc_len % 7 <> 6 AND token <> 'market' AND n_name <> 'asia'
  UNION ALL SELECT '' AS token, id, 0 AS name_tf, 0 AS alias_tf, 0 AS address_tf, kind, closed, doc_len, n_name FROM postings WHERE token = '17' UNION ALL SELECT token, id, name_tf, alias_tf, address_tf, kind, closed, doc_len, n_name FROM postings WHERE token = 'red'""",
    "s": "SELECT n_docs + 1 AS n_docs, avg_doc_len FROM stats",
    "a": "SELECT id, address_key FROM entities WHERE kind = 'address' AND NOT closed AND address_key IS NOT NULL AND k % 269 <> 14 UNION ALL SELECT id, 'none' AS address_key FROM entities WHERE kind = 'area'",
}
ALONE = {
    "entities_without_id": "id IS NULL", "entities_without_key": "coalesce(key, '') = ''", "names_empty": "coalesce(n_name, '') = ''", "names_too_long": "length(name) > 200",
    "kinds_unknown": "coalesce(kind, '') NOT IN ('area', 'street', 'business', 'address')", "coordinates_invalid": "NOT coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false)",
    "prominence_outside": "NOT coalesce(prominence BETWEEN 0 AND 100, false)", "confidence_outside": "NOT coalesce(confidence BETWEEN 0 AND 1, false)",
    "lengths_wrong": f"doc_len IS DISTINCT FROM {S.words('n_name')} + {S.words('n_alias')} + {S.words('n_address')}", "addresses_without_key": "kind = 'address' AND address_key IS NULL",
    "parents_unknown": "parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM e)", "parents_not_areas": "parent_id IN (SELECT id FROM e) AND parent_id NOT IN (SELECT id FROM e WHERE kind = 'area')",
    "entities_without_postings": "doc_len > 0 AND id NOT IN (SELECT id FROM p)", "words_not_posted": "(SELECT sum(name_tf + alias_tf + address_tf) FROM p WHERE p.id = e.id) <> doc_len",
    "copied_fields_differ": "EXISTS (SELECT 1 FROM p WHERE p.id = e.id AND (p.kind, p.closed, p.doc_len, p.n_name) IS DISTINCT FROM (e.kind, e.closed, e.doc_len, e.n_name))",
}
APART = {
    "ids_repeated": "SELECT count(*) - count(DISTINCT id) FROM e", "keys_repeated": "SELECT count(*) - count(DISTINCT key) FROM e", "tokens_empty": "SELECT count(*) FROM p WHERE token = ''",
    "frequencies_empty": "SELECT count(*) FROM p WHERE name_tf + alias_tf + address_tf <= 0", "postings_repeated": "SELECT count(*) - count(DISTINCT (token, id)) FROM p",
    "postings_without_entity": "SELECT count(DISTINCT id) FROM p WHERE id NOT IN (SELECT id FROM e)", "count_wrong": "SELECT count(*) FROM s WHERE n_docs <> (SELECT count(*) FROM e)",
    "mean_wrong": "SELECT count(*) FROM s WHERE abs(avg_doc_len - (SELECT avg(doc_len) FROM e)) > 1e-9",
    "addresses_not_listed": "SELECT count(*) FROM e WHERE kind = 'address' AND NOT closed AND address_key IS NOT NULL AND (id, address_key) NOT IN (SELECT (id, address_key) FROM a)",
    "listed_not_addresses": "SELECT count(*) FROM a WHERE (id, address_key) NOT IN (SELECT (id, address_key) FROM e WHERE kind = 'address' AND NOT closed AND address_key IS NOT NULL)",
}


@query("catalog_integrity", f"WITH {S.CATALOG}, " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in DAMAGED.items()) + " " + " UNION ALL ".join([f"SELECT '{n}' AS \"check\", count(*) AS n FROM e WHERE {q}" for n, q in ALONE.items()] + [f"SELECT '{n}', ({q})" for n, q in APART.items()]))
def catalog_integrity(spark, sf_dir):
    """The faults of a damaged copy of the catalog, by 25 checks."""
    e = places(spark, sf_dir)
    p = catalog.postings(e)
    made = {n: spark.sql(q.replace("FROM entities", "FROM {entities}").replace("FROM postings", "FROM {postings}").replace("FROM stats", "FROM {stats}"), entities=e, postings=p, stats=catalog.corpus_stats(e)) for n, q in DAMAGED.items()}
    return integrity.catalog_checks(made["e"], made["p"], made["s"], made["a"])


NUMBERS = "SELECT l_orderkey AS nr FROM lineitem"


@query("contiguity", "SELECT min(nr) AS first, max(nr) AS last, CAST(count(*) AS BIGINT) AS n, max(nr) - min(nr) + 1 - count(DISTINCT nr) AS gaps, count(*) - count(DISTINCT nr) AS repeats FROM (" + NUMBERS + ")")
def contiguity(spark, sf_dir):
    """Whether the orders that lines name are numbered without gaps or repeats."""
    return integrity.contiguity(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nr")), "nr")


FIELDS = ["name", "address", "alias", "parent", "class_name", "address_key"]


@query("audit_completeness", f"WITH {S.PLACES} SELECT kind, count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE coalesce({f}, '') <> '') AS has_{f}" for f in FIELDS) + " FROM entities GROUP BY kind")
def audit_completeness(spark, sf_dir):
    return resolve.completeness(places(spark, sf_dir), "kind", FIELDS)


@query("duplicate_labels", f"WITH {S.PLACES} SELECT kind, count(*) AS labels, CAST(sum(n - 1) AS BIGINT) AS excess FROM (SELECT kind, n_name, count(*) AS n FROM entities GROUP BY kind, n_name HAVING count(*) > 1) GROUP BY kind")
def duplicate_labels(spark, sf_dir):
    return resolve.duplicate_labels(places(spark, sf_dir), "kind", "n_name")


GOLD = [(1, "business", None, 1), (5, "area", "saint nation 3", 1), (6, "area", "africa", 1), (12, None, None, 0), (3, "street", None, 2), (10, "business", None, 1), (11, "area", "europe", 1)]


@query("gold_checks", f"""WITH {S.CATALOG}, {INPUT_SQL}, {S.SEARCH}, {S.values('checks', GOLD, 'query_id, first_kind, first_name, min_results')}, h AS (SELECT * FROM hits WHERE rank <= 5), c AS (SELECT query_id, count(*) AS results FROM h GROUP BY query_id),
f AS (SELECT query_id, kind, n_name FROM h JOIN entities USING (id) WHERE rank = 1)
SELECT query_id, coalesce(results, 0) AS results, coalesce(results, 0) >= min_results AND (first_kind IS NULL OR coalesce(first_kind = kind, false)) AND (first_name IS NULL OR coalesce(first_name = n_name, false)) AS ok FROM checks LEFT JOIN c USING (query_id) LEFT JOIN f USING (query_id)""")
def gold_checks(spark, sf_dir):
    e = places(spark, sf_dir)
    ranked = search.posting_search(inputs(spark), catalog.postings(e), catalog.corpus_stats(e))
    return generation.gold_checks(spark.createDataFrame(GOLD, "query_id BIGINT, first_kind STRING, first_name STRING, min_results BIGINT"), ranked, e)


# Statistics


@query("percentiles_interpolated", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles_interpolated(spark, sf_dir):
    at = lambda p: F.round(F.percentile("value", p), 6)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("percentiles_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles_nearest_rank(spark, sf_dir):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


OUTCOMES = f"SELECT c_nationkey, {S.metres('24.0 + c_nationkey', '-100.0', '24.0 + c_nationkey + CAST(c_custkey % 200 AS DOUBLE) / 1000', '-100.0')} AS m FROM customer"


@query("radius_histogram", f"SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE m <= 100) AS m100, count(*) FILTER (WHERE m <= 1000) AS km1, count(*) FILTER (WHERE m <= 10000) AS km10, round(median(m), 3) AS median_m FROM ({OUTCOMES}) GROUP BY c_nationkey")
def radius_histogram(spark, sf_dir):
    lat = F.lit(24.0) + F.col("c_nationkey")
    away = geo.distance(lat, F.lit(-100.0), lat + (F.col("c_custkey") % 200).cast("double") / 1000, F.lit(-100.0))
    rows = read(spark, sf_dir, "customer").select("c_nationkey", away.alias("m"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("m") <= 100).alias("m100"), F.count_if(F.col("m") <= 1000).alias("km1"), F.count_if(F.col("m") <= 10000).alias("km10"), F.round(F.median("m"), 3).alias("median_m"))
