"""The search catalog: entities, names, tokens, postings, prefix heads, address tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import cell_of
from plumbline.functions.text import address_context, address_key, normalize, public_id, word_count
from plumbline.operators.lineage import cut

NAME_WEIGHT, ALIAS_WEIGHT, ADDRESS_WEIGHT = 10.0, 5.0, 1.0
SATURATION, LENGTH_SHARE = 1.2, 0.75


def entities(places: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Raw place rows with public ids and the normalized forms that are searched."""
    own = places.withColumn("id", public_id(F.col("key"))).withColumn("parent_id", F.when(F.col("parent") != "", public_id(F.col("parent"))))
    for c in ("name", "address", "alias"):
        own = own.withColumn(f"n_{c}", normalize(F.col(c), ascii_only))
    is_address = F.col("kind") == "address"
    return own.withColumns({
        "doc_len": (word_count(F.col("n_name")) + word_count(F.col("n_alias")) + word_count(F.col("n_address"))).cast("int"),
        "address_key": F.when(is_address, address_key(F.col("name"), ascii_only)),
        "address_context": F.when(is_address, address_context(F.col("name"), F.col("address"), ascii_only)),
    })


def postings(entities_: DataFrame) -> DataFrame:
    """(token, id) with how often the token occurs in name, alias and address, and what ranking needs of the entity."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("text")) for f in ("name", "alias", "address")])
    words = entities_.select("id", "kind", "closed", "doc_len", "n_name", F.explode(fields).alias("f"))
    words = words.where(F.col("f.text") != "").select("id", "kind", "closed", "doc_len", "n_name", F.col("f.field").alias("field"), F.explode(F.split("f.text", " ")).alias("token"))
    of = lambda f: F.count_if(F.col("field") == f).alias(f"{f}_tf")
    # Kind, closed, length and name depend on the id alone.
    keep = [F.any_value(c).alias(c) for c in ("kind", "closed", "doc_len", "n_name")]
    return words.groupBy("token", "id").agg(of("name"), of("alias"), of("address"), *keep)


def corpus_stats(entities_: DataFrame) -> DataFrame:
    """One row: how many entities there are, closed ones included, and their mean length."""
    return entities_.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_doc_len"))


def frequency(name: Column, alias: Column, address: Column) -> Column:
    return NAME_WEIGHT * name + ALIAS_WEIGHT * alias + ADDRESS_WEIGHT * address


def bm25(tf: Column, df: Column, doc_len: Column, n: Column, avg: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.000001))
    return idf * ((tf * (SATURATION + 1)) / (tf + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * doc_len / avg)))


KIND_RANK = {"area": 0, "street": 1, "business": 2}


def kind_rank(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, r in KIND_RANK.items():
        out = out.when(kind == k, r)
    return out.otherwise(3)


def one_street_each(*by: str) -> list[Column]:
    """Partition columns under which streets of one name count once and all else by id."""
    is_street = F.col("kind") == "street"
    return [*(F.col(c) for c in by), is_street, F.when(is_street, F.col("n_name")).otherwise(F.col("id"))]


def prefix_heads(postings_: DataFrame, stats: DataFrame, top: int = 5) -> DataFrame:
    """The best ``top`` open entities of each prefix of one or two letters, streets of one name once."""
    prefixes = F.when(F.length("token") >= 2, F.array(F.left("token", F.lit(1)), F.left("token", F.lit(2)))).otherwise(F.array(F.col("token")))
    each = postings_.where(~F.col("closed")).select("*", F.explode(prefixes).alias("prefix"))
    tf = each.groupBy("prefix", "id").agg(F.sum(frequency(F.col("name_tf"), F.col("alias_tf"), F.col("address_tf"))).alias("tf"), *[F.any_value(c).alias(c) for c in ("kind", "doc_len", "n_name")])
    scored = tf.crossJoin(F.broadcast(stats))  # one row
    share = (F.col("tf") * (SATURATION + 1)) / (F.col("tf") + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("doc_len") / F.col("avg_doc_len")))
    scored = scored.withColumns({"share": F.round(share, 9), "exact_rank": F.when(F.col("n_name") == F.col("prefix"), 0).otherwise(1), "name_rank": F.when(F.col("n_name").startswith(F.col("prefix")), 0).otherwise(1), "kind_rank": kind_rank(F.col("kind"))})
    order = [F.col("exact_rank"), F.col("name_rank"), F.col("kind_rank"), F.col("share").desc(), F.col("id")]
    once = scored.withColumn("seen", F.row_number().over(Window.partitionBy(*one_street_each("prefix")).orderBy(*order))).where("seen = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).where(F.col("rank") <= top).select("prefix", "rank", "id")


def address_lookup(entities_: DataFrame) -> DataFrame:
    """Open addresses by exact key, sorted for range reads."""
    own = entities_.where((F.col("kind") == "address") & ~F.col("closed") & F.col("address_key").isNotNull())
    return own.select("address_key", "address_context", "id", "lat", "lng")


def address_cells(entities_: DataFrame) -> DataFrame:
    own = entities_.where((F.col("kind") == "address") & ~F.col("closed"))
    return own.select(cell_of(F.col("lat"), F.col("lng")).alias("cell"), "id", "lat", "lng")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a 1-based rank by ``key`` and no partition that holds all rows.

    Rows are dealt into ranges and kept so by a checkpoint, as another run of the same plan could
    cut them elsewhere. The sizes of the ranges, which are few, give each its first number, and
    each range numbers its own.
    """
    spread = cut(rows.repartitionByRange(key)).withColumn("_part", F.spark_partition_id())
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"))
    firsts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return spread.withColumn("_in", within).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_first", "_in")
