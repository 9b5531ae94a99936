"""Whether a published catalog holds together: its entities, postings, statistics and look-up table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import valid_point
from plumbline.functions.text import word_count

KINDS = ("area", "street", "business", "address")
LONGEST_NAME = 200


def _listed(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(check, n) of aggregates over ``rows``, all in one pass."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in counts])).alias("c")).select("c.check", "c.n")


def _unlike(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def catalog_checks(entities: DataFrame, postings: DataFrame, stats: DataFrame, lookup: DataFrame) -> DataFrame:
    """(check, n): how many faults of each kind a catalog has; a sound one has none.

    Entities and postings meet once, by id, after postings are summed by entity; everything about
    one table alone is counted in one pass over it. Nulls count as faults where a value must be.
    """
    words = word_count(F.col("n_name")) + word_count(F.col("n_alias")) + word_count(F.col("n_address"))
    must = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    alone = _listed(entities, {
        "entities_without_id": F.count_if(F.col("id").isNull()),
        "entities_without_key": must(F.col("key") != ""),
        "names_empty": must(F.col("n_name") != ""),
        "names_too_long": F.count_if(F.length("name") > LONGEST_NAME),
        "kinds_unknown": must(F.col("kind").isin(*KINDS)),
        "coordinates_invalid": must(valid_point(F.col("lat"), F.col("lng"))),
        "prominence_outside": must(F.col("prominence").between(0, 100)),
        "confidence_outside": must(F.col("confidence").between(0, 1)),
        "lengths_wrong": must(F.col("doc_len") == words),
        "addresses_without_key": F.count_if((F.col("kind") == "address") & F.col("address_key").isNull()),
    })
    excess = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("_n"))
    ids = _listed(excess(entities, "id"), {"ids_repeated": F.sum(F.col("_n") - 1)})
    keys = _listed(excess(entities, "key"), {"keys_repeated": F.sum(F.col("_n") - 1)})
    areas = entities.groupBy(F.col("id").alias("parent_id")).agg(F.max(F.col("kind") == "area").alias("is_area"))
    children = entities.where(F.col("parent_id").isNotNull()).select("parent_id").join(areas, "parent_id", "left")
    parents = _listed(children, {"parents_unknown": F.count_if(F.col("is_area").isNull()), "parents_not_areas": F.count_if(~F.col("is_area"))})

    tf = F.col("name_tf") + F.col("alias_tf") + F.col("address_tf")
    tokens = postings.groupBy("token", "id").agg(F.count("*").alias("_n"))
    own = _listed(postings, {"tokens_empty": must(F.col("token") != ""), "frequencies_empty": must(tf > 0)})
    doubles = _listed(tokens, {"postings_repeated": F.sum(F.col("_n") - 1)})
    copied = ["kind", "closed", "doc_len", "n_name"]
    # Rows of one entity must agree in what they carry of it: least and greatest say so without a list.
    summed = postings.groupBy(F.col("id").alias("p_id")).agg(F.sum(tf).alias("p_words"), *[f(c).alias(f"p_{n}_{c}") for c in copied for n, f in (("least", F.min), ("most", F.max))])
    both = entities.join(summed, F.col("id") == F.col("p_id"), "full_outer").withColumn("known", F.col("id").isNotNull() & F.col("p_id").isNotNull())
    differ = F.lit(False)
    for c in copied:
        differ = differ | _unlike(c, f"p_least_{c}") | _unlike(c, f"p_most_{c}")
    met = _listed(both, {
        "postings_without_entity": F.count_if(F.col("id").isNull() & F.col("p_id").isNotNull()),
        "entities_without_postings": F.count_if(F.col("p_id").isNull() & (F.col("doc_len") > 0)),
        "words_not_posted": F.count_if(F.col("known") & _unlike("p_words", "doc_len")),
        "copied_fields_differ": F.count_if(F.col("known") & differ),
    })

    true = entities.agg(F.count("*").alias("t_docs"), F.avg("doc_len").alias("t_avg"))
    told = _listed(stats.crossJoin(F.broadcast(true)), {  # one row each
        "count_wrong": F.count_if(_unlike("n_docs", "t_docs")),
        "mean_wrong": F.count_if(_unlike("avg_doc_len", "t_avg") & ~F.coalesce(F.abs(F.col("avg_doc_len") - F.col("t_avg")) <= 1e-9, F.lit(False))),
    })

    wanted = entities.where((F.col("kind") == "address") & ~F.col("closed") & F.col("address_key").isNotNull()).select("id", "address_key", F.lit(True).alias("wanted"))
    listed = lookup.select("id", "address_key", F.lit(True).alias("held"))
    pairs = wanted.join(listed, ["id", "address_key"], "full_outer")
    looked = _listed(pairs, {"addresses_not_listed": F.count_if(F.col("held").isNull()), "listed_not_addresses": F.count_if(F.col("wanted").isNull())})
    out = alone
    for part in (ids, keys, parents, own, doubles, met, told, looked):
        out = out.unionAll(part)
    return out


def contiguity(rows: DataFrame, number: str) -> DataFrame:
    """(first, last, n, gaps, repeats) of a column that must number rows without a gap."""
    seen = rows.groupBy(F.col(number).alias("at")).agg(F.count("*").alias("n"))
    one = seen.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("at").alias("different"))
    return one.select("first", "last", "n", F.coalesce(F.col("last") - F.col("first") + 1 - F.col("different"), F.lit(0)).alias("gaps"), (F.col("n") - F.col("different")).alias("repeats"))
