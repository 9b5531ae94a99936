"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``, with ``n_chars`` of the text as it then is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import lines, ngram_join, packing, passages, quality
from plumbline.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality.kept(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts."""
    return _documents(lines.without_boilerplate(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest doc_id; ids that are null come last. Rows equal in all columns are one."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("key"))
    joined = ngram_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
    ids = keyed.select("key", F.col("doc_id").isNull().alias("late"), "doc_id").distinct()
    first = joined.distinct().join(ids, "key").groupBy("component").agg(F.min(F.struct("late", "doc_id", "key")).alias("first"))
    return keyed.join(first.select("first.key"), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each repeated passage in the first document that has it."""
    return _documents(passages.without_passages(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the alignment and the packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
