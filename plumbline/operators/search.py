"""Batch look-ups over the catalog: a table of queries in, ranked rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import DEGREE_METRES, centre_lng, contains, distance, turn_between
from plumbline.functions.text import context_of, has_street_suffix, normalize, text_match_class
from plumbline.operators.catalog import bm25, frequency, kind_rank, one_street_each
from plumbline.operators.lineage import cut

AREA_RANKS = {"region": 0, "locality": 1, "macrohood": 2, "neighborhood": 3, "county": 4}


def query_words(queries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(query_id, q, n, pos, word, is_last) of (query_id, input)."""
    own = queries.withColumn("q", normalize(F.col("input"), ascii_only)).where(F.col("q") != "")
    words = own.select("query_id", "q", F.size(F.split("q", " ")).alias("n"), F.posexplode(F.split("q", " ")).alias("pos", "word"))
    return words.withColumn("is_last", F.col("pos") == F.col("n") - 1)


def token_matches(words: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings that each query word hits: equal tokens, and for the last word tokens that begin with it.

    The prefix join is an equi-join on the first one to three letters, whichever the word has.
    """
    key = lambda c, n: F.left(c, F.lit(n))
    tokens = postings.select("token").distinct()
    keyed = tokens.select("token", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), key(F.col("token"), n).alias("lead")) for n in (1, 2, 3)])).alias("k")).select("token", "k.size", "k.lead").where(F.length("lead") == F.col("size"))
    last = words.where("is_last").withColumn("size", F.least(F.length("word"), F.lit(3))).withColumn("lead", F.left("word", F.col("size")))
    begun = last.join(keyed, ["size", "lead"]).where(F.col("token").startswith(F.col("word"))).select("query_id", "q", "n", "pos", "token")
    whole = words.where("not is_last").join(tokens, F.col("word") == F.col("token")).select("query_id", "q", "n", "pos", "token")
    return whole.unionAll(begun).join(postings, "token")


def posting_search(queries: DataFrame, postings: DataFrame, stats: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id, score): entities that all words hit, by exactness, kind and field-weighted BM25."""
    hits = token_matches(query_words(queries, ascii_only), postings)
    word = ["query_id", "q", "n", "pos"]
    tf = frequency(F.sum("name_tf"), F.sum("alias_tf"), F.sum("address_tf")).alias("tf")
    each = hits.groupBy(*word, "id").agg(tf, *[F.any_value(c).alias(c) for c in ("kind", "closed", "doc_len", "n_name")])
    df = each.groupBy("query_id", "pos").agg(F.count("*").alias("df"))  # closed ones count
    each = each.join(df, ["query_id", "pos"])
    scored = each.where(~F.col("closed")).crossJoin(F.broadcast(stats))  # one row
    scored = scored.withColumn("part", bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("avg_doc_len")))
    every = scored.groupBy("query_id", "q", "n", "id").agg(F.count("*").alias("hit"), F.sum("part").alias("sum"), *[F.any_value(c).alias(c) for c in ("kind", "n_name")])
    every = every.where(F.col("hit") == F.col("n")).withColumn("score", F.round("sum", 6))
    return _ranked(every, limit).select("query_id", "rank", "id", "score")


def search_order() -> list[Column]:
    exact = F.when(F.col("n_name") == F.col("q"), 0).otherwise(1)
    begins = F.when(F.col("n_name").startswith(F.col("q")), 0).otherwise(1)
    return [exact, begins, kind_rank(F.col("kind")), F.col("score").desc(), F.col("id")]


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    order = search_order()
    once = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*one_street_each("query_id")).orderBy(*order))).where("seen = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def area_rank(subtype: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, r in AREA_RANKS.items():
        out = out.when(subtype == k, r)
    return out.otherwise(9)


def exact_areas(queries: DataFrame, entities: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): open areas whose name is the query, by type, prominence and id."""
    own = queries.withColumn("q", normalize(F.col("input"), ascii_only))
    areas = entities.where((F.col("kind") == "area") & ~F.col("closed"))
    hits = own.join(areas, own["q"] == areas["n_name"])
    order = Window.partitionBy("query_id").orderBy(area_rank(F.col("subtype")), F.col("prominence").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def merged_first(parts: list[DataFrame], limit: int) -> DataFrame:
    """(query_id, rank, id): candidate lists (query_id, rank, id) one after the other, the first place of an id counts."""
    out = None
    for i, p in enumerate(parts):
        rows = p.select("query_id", F.lit(i).alias("source"), F.col("rank").alias("place"), "id")
        out = rows if out is None else out.unionAll(rows)
    first = out.groupBy("query_id", "id").agg(F.min(F.struct("source", "place")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def merged_best(parts: list[DataFrame]) -> DataFrame:
    """(query_id, id, score): the highest score of an id in any of the lists."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def place_evidence(entities: DataFrame) -> DataFrame:
    """Ranking evidence of businesses: confidence tier, class and depth of the taxonomy, and whether it outranks areas."""
    c, k = F.col("confidence"), F.col("class_name")
    tier = F.when(c >= 0.95, 3).when(c >= 0.75, 2).when(c > 0, 1).otherwise(0)
    kind = F.when(k == "cultural_and_historic", 4).when(k.isin("arts_and_entertainment", "community_and_government"), 3).when(k == "sports_and_recreation", 2).when(k == "geographic_entities", 1).otherwise(0)
    depth = F.when(k != "", F.size(F.split(k, "_")))
    override = k.isin("monument", "stadium_arena") | k.endswith("_stadium")
    return entities.where(F.col("kind") == "business").select("id", "n_name", "closed", tier.alias("tier"), F.coalesce(depth, F.lit(0)).alias("depth"), kind.alias("class"), override.alias("override"))


def promoted(queries: DataFrame, baseline: DataFrame, entities: DataFrame, limit: int = 5, most: int = 64, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): the baseline, with the best exact-name business first where its evidence beats the first row.

    Not if the first row has another name, is a street asked for by its suffix, or is an area
    of a leading type; nor where more than ``most`` businesses have the name.
    """
    own = queries.select("query_id", normalize(F.col("input"), ascii_only).alias("q"))
    shown = entities.select("id", "kind", "subtype", "n_name")
    first = baseline.where("rank = 1").join(shown, "id").join(own, "query_id").where(F.col("n_name") == F.col("q"))
    first = first.where(~((F.col("kind") == "street") & has_street_suffix(F.col("q")))).where(~((F.col("kind") == "area") & (area_rank(F.col("subtype")) <= 1)))
    evidence = place_evidence(entities).where(~F.col("closed"))
    held = evidence.select(F.col("id").alias("first_id"), F.col("tier").alias("t0"), F.col("depth").alias("d0"), F.col("class").alias("c0"))
    first = first.select("query_id", "q", F.col("id").alias("first_id"), F.col("kind").alias("first_kind")).join(held, "first_id", "left")
    found = first.join(evidence.select("id", "n_name", "tier", "depth", "class", "override"), F.col("q") == F.col("n_name"))
    found = found.withColumn("m", F.count("*").over(Window.partitionBy("query_id"))).where((F.col("m") <= most) & (F.col("id") != F.col("first_id")))
    stronger = F.struct("tier", "depth", "class") > F.struct("t0", "d0", "c0")
    better = F.when(F.col("c0") == 0, F.col("class") != 0).when(F.col("class") == F.col("c0"), stronger).otherwise((F.col("c0") == 1) & F.col("class").isin(3, 4))
    fits = F.when(F.col("first_kind") == "area", F.col("override")).when(F.col("first_kind") == "business", F.coalesce(better, F.lit(False))).otherwise(F.col("class") != 0)
    ranks = baseline.select("query_id", "id", F.col("rank").alias("place"))
    fit = found.where(fits).join(ranks, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("depth"), F.desc("class"), F.col("place").asc_nulls_last(), F.col("id"))
    best = fit.withColumn("at", F.row_number().over(w)).where("at = 1").select("query_id", F.lit(1).alias("rank"), "id")
    return merged_first([best, baseline], limit)


def unstructured(queries: DataFrame, entities: DataFrame, postings: DataFrame, stats: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """Exact areas, then posting hits, then promotion of an exact destination."""
    both = merged_first([exact_areas(queries, entities, limit, ascii_only), posting_search(queries, postings, stats, limit, ascii_only)], limit)
    return promoted(queries, both, entities, limit, ascii_only=ascii_only)


def viewport_ranked(baseline: DataFrame, queries: DataFrame, entities: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """The baseline by how the name matches, whether it lies inside the viewport, and distance from its centre; ties keep their order."""
    own = queries.withColumn("q", normalize(F.col("input"), ascii_only))
    rows = baseline.join(entities.select("id", "n_name", "lat", "lng"), "id").join(own.drop("input"), "query_id")
    inside = contains(F.col("south"), F.col("west"), F.col("north"), F.col("east"), F.col("lat"), F.col("lng"))
    away = distance((F.col("south") + F.col("north")) / 2, centre_lng(F.col("west"), F.col("east")), F.col("lat"), F.col("lng"))
    rows = rows.withColumns({"class": text_match_class(F.col("q"), F.col("n_name")), "inside": inside, "metres": F.round(away, 3)})
    w = Window.partitionBy("query_id").orderBy("class", F.desc("inside"), "metres", "rank")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", F.col("place").alias("rank"), "id", "inside", "metres")


def ancestors(children: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, ancestor) closure of (id, parent_id); a cycle ends where nothing new comes up.

    Each round joins only what the last one found; earlier rounds are cut off by checkpoints.
    """
    edges = children.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("ancestor")).distinct()
    up = edges.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    seen, frontier = edges, edges
    for _ in range(max_rounds):
        found = frontier.join(up, "ancestor").select("id", F.col("next").alias("ancestor")).distinct()
        frontier = found.join(seen, ["id", "ancestor"], "left_anti")
        frontier = cut(frontier)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionAll(frontier))
    raise ValueError(f"parents go on for more than {max_rounds} steps")


def in_context(queries: DataFrame, entities: DataFrame, closure: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): localities named in ``city, state`` inputs that lie under the named region.

    ``queries`` has (query_id, name, region): parsed and normalized.
    """
    regions = entities.where((F.col("kind") == "area") & (F.col("subtype") == "region") & ~F.col("closed")).select(F.col("id").alias("region_id"), F.col("n_name").alias("region"))
    places = entities.where((F.col("kind") == "area") & ~F.col("closed") & (area_rank(F.col("subtype")).between(1, 3))).select("id", "n_name", "subtype", "prominence")
    hits = queries.join(regions, "region").join(places, F.col("name") == F.col("n_name"))
    under = closure.select("id", F.col("ancestor").alias("region_id"))
    hits = hits.join(under, ["id", "region_id"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(area_rank(F.col("subtype")), F.desc("prominence"), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def street_near(anchors: DataFrame, entities: DataFrame, near: float = 25_000.0, far: float = 100_000.0) -> DataFrame:
    """(query_id, id, metres): of the streets with the name, the smallest id within ``near`` of the anchor, else the nearest within ``far``.

    ``anchors`` has (query_id, name, lat, lng).
    """
    streets = entities.where((F.col("kind") == "street") & ~F.col("closed")).select("id", "n_name", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    hits = anchors.join(streets, F.col("name") == F.col("n_name"))
    hits = hits.withColumn("metres", F.round(distance(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")), 3)).where(F.col("metres") <= far)
    close = F.col("metres") <= near
    w = Window.partitionBy("query_id").orderBy(F.when(close, 0).otherwise(1), F.when(close, 0.0).otherwise(F.col("metres")), "id")
    return hits.withColumn("at", F.row_number().over(w)).where("at = 1").select("query_id", "id", "metres")


def parsed_context(queries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(query_id, name, locality, region_code) of the inputs that are ``city, state`` or ``street, city, state``."""
    own = queries.select("query_id", context_of(F.col("input"), ascii_only).alias("c")).where(F.col("c").isNotNull())
    return own.select("query_id", "c.name", "c.locality", "c.region_code")


def nearest_addresses(viewports: DataFrame, entities: DataFrame, k: int = 8, metres: float = 5_000.0) -> DataFrame:
    """(query_id, rank, id): the k open addresses nearest to a viewport's centre in the plane, within ``metres`` on the sphere.

    Viewports of more than two degrees have no such context; those that cross the antimeridian
    count by what they span. Candidates come by grid cells of a tenth of a degree that the circle
    meets, so only rows near a centre meet it.
    """
    high, broad = F.col("north") - F.col("south"), F.col("east") - F.col("west") + F.when(F.col("west") > F.col("east"), 360.0).otherwise(0.0)
    small = (high > 0) & (high <= 2) & (broad > 0) & (broad <= 2)
    v = viewports.where(small).select("query_id", ((F.col("south") + F.col("north")) / 2).alias("c_lat"), centre_lng(F.col("west"), F.col("east")).alias("c_lng"))
    cell = lambda x: F.floor(x * 10).cast("long")
    column = lambda c: F.pmod(c, F.lit(3_600))
    up = metres / DEGREE_METRES * 1.001
    wide = F.least(F.lit(180.0), up / F.greatest(F.cos(F.radians(F.least(F.abs("c_lat") + up, F.lit(90.0)))), F.lit(1e-9)))
    reach = lambda c, by: F.explode(F.sequence(cell(F.col(c) - by), cell(F.col(c) + by)))
    v = v.select("*", reach("c_lat", F.lit(up)).alias("cy")).select("*", reach("c_lng", wide).alias("cx")).withColumn("cx", column(F.col("cx"))).distinct()
    own = entities.where((F.col("kind") == "address") & ~F.col("closed")).select("id", "lat", "lng", cell(F.col("lat")).alias("cy"), column(cell(F.col("lng"))).alias("cx"))
    hits = v.join(own, ["cy", "cx"]).where(distance(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")) <= metres)
    plane = F.pow(F.col("lat") - F.col("c_lat"), 2) + F.pow(turn_between(F.col("c_lng"), F.col("lng")) * F.cos(F.radians("c_lat")), 2)
    w = Window.partitionBy("query_id").orderBy(F.round(plane, 12), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id")


def viewport_words(viewports: DataFrame, entities: DataFrame, components: DataFrame, k: int = 8, metres: float = 5_000.0) -> DataFrame:
    """(query_id, context): locality and region, normalized, of the first of a viewport's nearest addresses that has both.

    ``components`` is (id, locality, region); of a locality with commas the last part counts. The
    k nearest are taken in the plane and put in order on the sphere. Viewports without such an
    address have no row.
    """
    centre = viewports.select("query_id", ((F.col("south") + F.col("north")) / 2).alias("c_lat"), centre_lng(F.col("west"), F.col("east")).alias("c_lng"))
    near = nearest_addresses(viewports, entities, k, metres).join(centre, "query_id").join(entities.select("id", "lat", "lng"), "id").join(components, "id")
    locality, region = normalize(F.element_at(F.split("locality", ","), -1)), normalize(F.col("region"))
    away = F.round(distance(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")), 6)
    told = near.select("query_id", "id", away.alias("away"), locality.alias("l"), region.alias("r")).where("l <> '' and r <> ''")
    first = told.groupBy("query_id").agg(F.min_by(F.concat_ws(" ", "l", "r"), F.struct("away", "id")).alias("context"))
    return first.select("query_id", "context")


def search_in_view(queries: DataFrame, contexts: DataFrame, postings: DataFrame, stats: DataFrame, limit: int = 5, contextual: int = 25, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): what a query finds together with the words of its viewport, then what it finds alone.

    ``contexts`` is what ``viewport_words`` gives. Both searches are one, over queries that carry
    which of the two they are.
    """
    own = queries.withColumn("q", normalize(F.col("input"), ascii_only)).where(F.col("q") != "")
    key = lambda source: F.struct("query_id", F.lit(source).alias("source")).alias("query_id")
    both = own.join(contexts, "query_id").select(key(0), F.concat_ws(" ", "q", "context").alias("input")).unionAll(own.select(key(1), F.col("q").alias("input")))
    found = posting_search(both, postings, stats, max(limit, contextual), ascii_only)
    part = lambda source, n: found.where((F.col("query_id.source") == source) & (F.col("rank") <= n)).select("query_id.query_id", "rank", "id")
    return merged_first([part(0, contextual), part(1, limit)], limit + contextual)


def fuzzy_terms(words: DataFrame, tokens: DataFrame, most: int = 256, keep: int = 8, limit: int = 2) -> DataFrame:
    """(query_id, pos, term, edits): dictionary terms like a word of four letters or more.

    They share its first two letters, differ by ``limit`` in length and edits at most, and come
    from the ``most`` most frequent such terms; the ``keep`` nearest stay. ``tokens`` is (token, df).
    """
    long_ = words.where(F.length("word") >= 4).select("query_id", "pos", "word", F.left("word", F.lit(2)).alias("lead"))
    hits = long_.join(tokens.withColumn("lead", F.left("token", F.lit(2))), "lead").where(F.abs(F.length("token") - F.length("word")) <= limit)
    often = Window.partitionBy("query_id", "pos").orderBy(F.desc("df"), "token")
    hits = hits.withColumn("at", F.row_number().over(often)).where(F.col("at") <= most).withColumn("edits", F.levenshtein("word", "token", limit)).where("edits >= 0")
    near = Window.partitionBy("query_id", "pos").orderBy("edits", F.desc("df"), "token")
    return hits.withColumn("at", F.row_number().over(near)).where(F.col("at") <= keep).select("query_id", "pos", F.col("token").alias("term"), F.col("edits").cast("int").alias("edits"))
