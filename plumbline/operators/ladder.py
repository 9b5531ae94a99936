"""The second retrieval: typed names first, then words, then words like them; with its own ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import has_street_suffix, normalize, text_match_class
from plumbline.operators.catalog import frequency, kind_rank
from plumbline.operators.lineage import Tables
from plumbline.operators.search import fuzzy_terms, merged_first, posting_search, query_words



def typed_names(queries: DataFrame, entities: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): open entities whose name is or begins with the query, with or without a leading ``the``.

    Names meet queries by their first three letters, so no query meets all names.
    """
    own = queries.select("query_id", normalize(F.col("input"), ascii_only).alias("q")).where(F.length("q") > 0)
    bare = F.regexp_replace("n_name", "^the ", "")
    forms = F.explode(F.array_distinct(F.array(F.col("n_name"), bare))).alias("form")
    names = entities.where(~F.col("closed")).select("id", "kind", "n_name", forms)
    sizes = F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.length("form"))).alias("size")
    keyed = names.select("*", sizes).withColumn("lead", F.left("form", F.col("size")))
    asked = own.withColumn("size", F.least(F.length("q"), F.lit(3))).withColumn("lead", F.left("q", F.col("size")))
    hits = asked.join(keyed, ["size", "lead"]).where(F.col("form").startswith(F.col("q"))).select("query_id", "q", "id", "kind", "n_name").distinct()
    hits = hits.withColumn("class", text_match_class(F.col("q"), F.col("n_name")))
    prefers = F.when(has_street_suffix(F.col("q")) & (F.col("kind") == "street"), 0).otherwise(1)
    street = F.col("kind") == "street"
    once = Window.partitionBy("query_id", street, F.when(street, F.col("n_name")).otherwise(F.col("id"))).orderBy("class", "id")
    hits = hits.withColumns({"prefers": prefers, "kind_rank": kind_rank(F.col("kind")), "seen": F.row_number().over(once)}).where("seen = 1")
    w = Window.partitionBy("query_id").orderBy("class", "prefers", "kind_rank", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def fuzzy_search(queries: DataFrame, postings: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rank, id): entities that have, for each word, the word itself or a term like it; fewest edits first."""
    words = query_words(queries, ascii_only).where(F.col("n") <= 4)
    tokens = postings.groupBy("token").agg(F.count("*").alias("df"))
    like = fuzzy_terms(words, tokens).select("query_id", "pos", F.col("term").alias("token"), "edits")
    same = words.select("query_id", "pos", F.col("word").alias("token"), F.lit(0).alias("edits"))
    terms = like.unionAll(same).groupBy("query_id", "pos", "token").agg(F.min("edits").alias("edits"))
    hits = terms.join(postings.where(~F.col("closed")), "token")
    best = hits.groupBy("query_id", "pos", "id", "kind").agg(F.min("edits").alias("edits"), F.max(frequency(F.col("name_tf"), F.col("alias_tf"), F.col("address_tf"))).alias("tf"))
    sizes = words.select("query_id", "n").distinct()
    every = best.groupBy("query_id", "id", "kind").agg(F.count("*").alias("hit"), F.sum("edits").alias("edits"), F.sum("tf").alias("tf")).join(sizes, "query_id").where("hit = n")
    w = Window.partitionBy("query_id").orderBy("edits", F.desc("tf"), kind_rank(F.col("kind")), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def ladder(queries: DataFrame, entities: DataFrame, postings: DataFrame, stats: DataFrame, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """(query_id, rung, rank, id): typed names; for queries without any, words; without those, words like them."""
    # A rung's rows are few, and the next ones ask which queries have any: made once, not again for each that asks.
    tables = Tables(queries.sparkSession)
    first = tables.write(typed_names(queries, entities, limit, ascii_only))
    rest = queries.join(first.select("query_id"), "query_id", "left_anti")
    second = tables.write(posting_search(rest, postings, stats, limit, ascii_only).select("query_id", "rank", "id"))
    letters = F.col("input").rlike(r"\p{L}") & (F.length(F.trim("input")) >= 4)
    last = rest.where(letters).join(second.select("query_id"), "query_id", "left_anti")
    third = fuzzy_search(last, postings, limit, ascii_only)
    out = None
    for rung, rows in ((1, first), (2, second), (3, third)):
        part = rows.select("query_id", F.lit(rung).alias("rung"), "rank", "id")
        out = part if out is None else out.unionAll(part)
    return out


def pooled(local: DataFrame, wide: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, rank, id) of two pools, the local one first."""
    return merged_first([local, wide], limit)
