"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. HyperLogLog sketches of the sites of each
line merge by aggregation; lines whose estimate is near the threshold get an exact
distinct count. Copies of a document spread its lines without making them boilerplate, so
the spread is taken twice: over all documents, which gives candidates, and then over the
witnesses among them, which are documents that candidates do not make up by more than half.
Every document loses the lines that are left, at whatever share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import free_names, table, written

MIN_SITES = 10
MIN_CHARS = 8
WITNESS_SHARE = 0.5
SKETCH_BITS = 12
#: Five standard errors of a sketch of 2^12 registers, and a site at least.
MARGIN = 0.08
KEY = ["h", "g"]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """Tells lines apart by 96 bits of hashes."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(u, site, h, g, chars, total) of the lines of each text of (site, text): ``u`` tells the text, ``total`` is its length."""
    own = docs.where(F.col("text").isNotNull()).select("site", F.xxhash64("text").alias("u"), F.length("text").alias("total"), F.explode(F.split("text", "\n")).alias("line"))
    rows = own.select("u", "site", "total", _trimmed(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    return rows.select("u", "site", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.length("line").alias("chars"), "total")


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, g) of the lines on ``min_sites`` distinct sites or more: by sketches where they are sure, by exact counts near the threshold."""
    lines = lines.where(F.col("site").isNotNull())
    margin = max(1.0, MARGIN * min_sites)
    spread = lines.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select(*KEY)
    counted = lines.join(near, KEY, "left_semi").groupBy(*KEY).agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites + margin).select(*KEY)
    return sure.unionAll(counted.where(F.col("sites") >= min_sites).select(*KEY))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, share: float = WITNESS_SHARE) -> DataFrame:
    """(u, h, g): the boilerplate lines of each text, of ``lines`` as ``lines_of`` makes them."""
    hits = written(lines.join(written(widespread(lines, min_sites), "line-candidates"), KEY, "left_semi"), "line-hits")
    # Each line of a text once, however many rows hold the text.
    covered = hits.groupBy("u", *KEY).agg(F.max("chars").alias("chars"), F.max("total").alias("total"))
    copies = covered.groupBy("u").agg(F.sum("chars").alias("chars"), F.max("total").alias("total")).where(F.col("chars") > share * F.col("total")).select("u")
    bad = widespread(hits.join(written(copies, "line-copies"), "u", "left_anti"), min_sites)
    return hits.join(written(bad, "boilerplate"), KEY, "left_semi").select("u", *KEY)


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the columns n_lines and n_removed.

    Lines end at line feeds and are compared without blanks around them; shorter ones than
    ``min_chars`` are never boilerplate. A line is boilerplate if ``min_sites`` distinct sites
    carry it in texts of whose characters the distinct lines on that many sites are no more than
    WITNESS_SHARE; so a copied document
    does not make its own lines boilerplate, while pages with much boilerplate lose it like
    others. A null text stays null and has no lines; rows without a site add none to a line's
    spread; rows may repeat, and their sites count once; rows without doc_id are cleaned like
    others. All columns and rows are kept; where the caller has columns of the new names, the
    new ones get an underscore more.
    """
    # The caller's columns travel in a struct, so that none of their names can clash with those made here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    own = written(lines_of(rows.select(F.col("row").getField(site).cast("string").alias("site"), text.alias("text")), min_chars), "lines")
    hit = boilerplate(own, min_sites).groupBy("u").agg(F.collect_set(F.struct(*KEY)).alias("hit"))
    # The texts with boilerplate grow with the input, so they are never broadcast.
    joined = rows.withColumn("t", F.xxhash64(text)).join(written(hit, "line-texts").hint("merge"), F.col("t") == F.col("u"), "left").select("row", "hit")
    lines = F.split(text, "\n")
    is_hit = lambda x: (F.length(_trimmed(x)) >= min_chars) & F.array_contains("hit", _key(_trimmed(x)))
    kept = F.when(F.col("hit").isNotNull(), F.filter(lines, lambda x: ~F.coalesce(is_hit(x), F.lit(False))))
    out = joined.withColumns({"n": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "kept": kept})
    n_removed = F.when(F.col("hit").isNotNull(), F.col("n") - F.size("kept")).otherwise(0).cast("long")
    new = F.when(F.col("hit").isNotNull(), F.array_join("kept", "\n")).otherwise(text)
    counts = [c.alias(name) for c, name in zip((F.col("n"), n_removed), free_names(COUNTS, docs.columns), strict=True)]
    return out.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], *counts)


COUNTS = ("n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    rows = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Takes a relation ``documents`` and makes ``lines_kept`` of it: all columns, with the text that stays.
SQL_STEP = """
{out}_l AS MATERIALIZED (
  SELECT DISTINCT text, source, trim(raw, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT text, source, unnest(string_split(text, chr(10))) AS raw FROM {docs} WHERE text IS NOT NULL)
  WHERE length(trim(raw, ' ' || chr(9) || chr(13))) >= 8
), {out}_a AS MATERIALIZED (
  SELECT line FROM {out}_l GROUP BY 1 HAVING count(DISTINCT source) >= 10
), {out}_t AS MATERIALIZED (
  SELECT text, coalesce(sum(length(line)) FILTER (line IN (FROM {out}_a)), 0) AS covered FROM (SELECT DISTINCT text, line FROM {out}_l) GROUP BY 1
), {out}_b AS MATERIALIZED (
  SELECT line FROM {out}_l WHERE line IN (FROM {out}_a) AND text IN (SELECT text FROM {out}_t WHERE covered <= 0.5 * length(text))
  GROUP BY 1 HAVING count(DISTINCT source) >= 10
), {out}_c AS MATERIALIZED (
  SELECT *, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS stay
  FROM {docs}, (SELECT coalesce(list(line), []) AS bad FROM {out}_b)
), {out} AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(stay) = len(lines) THEN text ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
    lang, source, n_chars, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(stay), 0) AS BIGINT) AS n_removed
  FROM {out}_c
)"""
ORACLE_SQL = f"WITH {SQL_STEP.format(docs='documents', out='kept')} SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept"
