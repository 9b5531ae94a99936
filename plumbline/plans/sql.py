"""Parts of the SQL by which another engine checks the queries."""

from __future__ import annotations

from plumbline.functions.text import EXPANSIONS, REGIONS
from plumbline.sources.places_view import RAW_SQL

WORDS = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXPANSIONS.items()) + " ELSE w END"


def norm(x: str) -> str:
    folded = f"trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"array_to_string(list_transform(list_filter(string_split({folded}, ' '), lambda w: w <> ''), lambda w: {WORDS}), ' ')"


def public_id(x: str) -> str:
    return f"'pl_' || substr(sha256('plumbline:entity:v1:' || {x}), 1, 32)"


def words(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


def address_key(x: str) -> str:
    head = f"split_part(trim({x}), ' ', 1)"
    rest = f"ltrim(substr(trim({x}), length({head}) + 1))"
    lettered = f"lower(right({head}, 1)) BETWEEN 'a' AND 'z'"
    digits = f"CASE WHEN {lettered} THEN left({head}, length({head}) - 1) ELSE {head} END"
    letter = f"CASE WHEN {lettered} THEN lower(right({head}, 1)) ELSE '' END"
    number = f"CASE WHEN ltrim({digits}, '0') = '' THEN '0' ELSE ltrim({digits}, '0') END"
    return f"CASE WHEN ({digits}) <> '' AND translate({digits}, '0123456789', '') = '' AND regexp_matches(left({rest}, 1), '\\p{{L}}') AND {norm(rest)} <> '' THEN {number} || ({letter}) || ' ' || {norm(rest)} END"


def metres(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    lat1, lng1, lat2, lng2 = (f"CAST({x} AS DOUBLE)" for x in (lat1, lng1, lat2, lng2))
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0, {h})))))"


def cell(lat: str, lng: str) -> str:
    return f"CAST(floor(({lat} + 90) * 1000) * 360001 + floor(({lng} + 180) * 1000) AS BIGINT)"


def centre() -> str:
    """The longitude of the middle of a viewport that may cross the antimeridian."""
    return "(CASE WHEN west <= east THEN (west + east) / 2 WHEN (west + east + 360) / 2 > 180 THEN (west + east) / 2 - 180 ELSE (west + east + 360) / 2 END)"


def inside(lat: str = "lat", lng: str = "lng") -> str:
    return f"({lat} >= south AND {lat} <= north AND CASE WHEN west <= east THEN {lng} >= west AND {lng} <= east ELSE {lng} >= west OR {lng} <= east END)"


ENTITIES = f"""entities AS MATERIALIZED (
  SELECT *, {words('n_name')} + {words('n_alias')} + {words('n_address')} AS doc_len,
    CASE WHEN kind = 'address' THEN {address_key('name')} END AS address_key,
    CASE WHEN kind = 'address' THEN {norm("substr(address, length(name) + 1)")} END AS address_context
  FROM (SELECT *, {public_id('key')} AS id, CASE WHEN parent <> '' THEN {public_id('parent')} END AS parent_id,
    {norm('name')} AS n_name, {norm('address')} AS n_address, {norm('alias')} AS n_alias FROM raw_places)
)"""
POSTINGS = """postings AS MATERIALIZED (
  SELECT token, id, count(*) FILTER (WHERE field = 1) AS name_tf, count(*) FILTER (WHERE field = 2) AS alias_tf, count(*) FILTER (WHERE field = 3) AS address_tf,
    any_value(kind) AS kind, any_value(closed) AS closed, any_value(doc_len) AS doc_len, any_value(n_name) AS n_name
  FROM (
    SELECT id, kind, closed, doc_len, n_name, 1 AS field, unnest(string_split(n_name, ' ')) AS token FROM entities WHERE n_name <> ''
    UNION ALL SELECT id, kind, closed, doc_len, n_name, 2, unnest(string_split(n_alias, ' ')) FROM entities WHERE n_alias <> ''
    UNION ALL SELECT id, kind, closed, doc_len, n_name, 3, unnest(string_split(n_address, ' ')) FROM entities WHERE n_address <> ''
  ) GROUP BY token, id
), stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_doc_len FROM entities)"""
KIND_RANK = "CASE kind WHEN 'area' THEN 0 WHEN 'street' THEN 1 WHEN 'business' THEN 2 ELSE 3 END"
AREA_RANK = "CASE subtype WHEN 'region' THEN 0 WHEN 'locality' THEN 1 WHEN 'macrohood' THEN 2 WHEN 'neighborhood' THEN 3 WHEN 'county' THEN 4 ELSE 9 END"
PLACES = f"{RAW_SQL}, {ENTITIES}"
CATALOG = f"{PLACES}, {POSTINGS}"


def values(name: str, rows: list[tuple], columns: str) -> str:
    """A CTE of literal rows, in either engine's SQL."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"


SEARCH = f"""asked AS (SELECT query_id, {norm('input')} AS q FROM queries),
qw AS (SELECT query_id, q, len(string_split(q, ' ')) AS n, unnest(generate_series(1, len(string_split(q, ' ')))) AS pos FROM asked WHERE q <> ''),
w AS (SELECT *, string_split(q, ' ')[pos] AS word FROM qw),
each AS (
  SELECT query_id, q, n, pos, id, 10.0 * sum(name_tf) + 5.0 * sum(alias_tf) + 1.0 * sum(address_tf) AS tf,
    any_value(kind) AS kind, any_value(closed) AS closed, any_value(doc_len) AS doc_len, any_value(n_name) AS n_name
  FROM w JOIN postings p ON CASE WHEN pos = n THEN starts_with(p.token, word) ELSE p.token = word END
  GROUP BY query_id, q, n, pos, id
), freq AS (SELECT *, count(*) OVER (PARTITION BY query_id, pos) AS df FROM each),
every AS (
  SELECT query_id, q, id, any_value(kind) AS kind, any_value(n_name) AS n_name,
    round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 0.000001) * ((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_doc_len)))), 6) AS score
  FROM freq, stats WHERE NOT closed GROUP BY query_id, q, n, id HAVING count(*) = n
), keyed AS (
  SELECT *, CASE WHEN n_name = q THEN 0 ELSE 1 END AS e, CASE WHEN starts_with(n_name, q) THEN 0 ELSE 1 END AS b, {KIND_RANK} AS r FROM every
), once AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind = 'street', CASE WHEN kind = 'street' THEN n_name ELSE id END ORDER BY e, b, r, score DESC, id) AS seen FROM keyed
), hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY e, b, r, score DESC, id) AS rank, id, score FROM once WHERE seen = 1
)"""
AREAS = f"""areas AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {AREA_RANK}, prominence DESC, id) AS rank, id
  FROM (SELECT query_id, {norm('input')} AS q FROM queries) JOIN entities ON n_name = q WHERE kind = 'area' AND NOT closed
)"""


def merged(name: str, parts: list[str], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, {i} AS source, rank AS place, id FROM {p}" for i, p in enumerate(parts))
    return f"""{name} AS (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, place, id) AS rank, id FROM (
    SELECT query_id, id, min(source) AS source, min(place) FILTER (WHERE source = first) AS place FROM (
      SELECT *, min(source) OVER (PARTITION BY query_id, id) AS first FROM ({union})) GROUP BY query_id, id)) WHERE rank <= {limit})"""


CODES = "CASE r " + " ".join(f"WHEN '{n}' THEN '{c}' WHEN '{EXPANSIONS.get(c.lower(), c.lower())}' THEN '{c}'" for c, n in REGIONS.items()) + " END"
