"""Place records derived from the star-schema tables by integer arithmetic.

The expressions are plain enough that any SQL engine gives the same values, which is
what lets another engine check the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["key", "kind", "subtype", "name", "address", "alias", "closed", "prominence", "confidence", "class_name", "parent", "k"]
SUFFIX = "CASE CAST({k} % 4 AS INT) WHEN 0 THEN 'St' WHEN 1 THEN 'Ave.' WHEN 2 THEN 'Rd' ELSE 'Lane' END"

#: For each table the columns above, as expressions.
SOURCES: dict[str, list[str]] = {
    "region": [
        "concat('region:', r_regionkey)", "'area'", "'region'", "r_name", "''", "''", "false", "CAST(r_regionkey % 100 + 1 AS INT)",
        "0.0", "'city'", "''", "CAST(r_regionkey AS BIGINT)",
    ],
    "nation": [
        "concat('nation:', n_nationkey)", "'area'", "CASE n_nationkey % 4 WHEN 0 THEN 'locality' WHEN 1 THEN 'county' WHEN 2 THEN 'macrohood' ELSE 'neighborhood' END",
        "concat('Saint Nation ', n_nationkey % 7)", "''", "n_name", "false", "CAST(n_nationkey % 100 + 1 AS INT)", "0.0",
        "CASE n_nationkey % 3 WHEN 0 THEN 'town' WHEN 1 THEN 'village' ELSE 'hamlet' END", "concat('region:', n_regionkey)", "CAST(n_nationkey AS BIGINT) + 100",
    ],
    "supplier": [
        "concat('supplier:', s_suppkey)", "'business'", "''", "concat('The Harbor ', s_suppkey % 11, ' Market')", "concat(s_suppkey % 90 + 1, ' Harbor St')",
        "s_name", "s_suppkey % 53 = 0", "0", "CAST(s_suppkey % 100 AS DOUBLE) / 100",
        "CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'cultural_and_historic' WHEN 1 THEN 'arts_and_entertainment' WHEN 2 THEN 'sports_and_recreation' WHEN 3 THEN 'geographic_entities' ELSE 'food_and_drink' END",
        "concat('nation:', s_nationkey)", "s_suppkey + 1000",
    ],
    "customer": [
        "concat('customer:', c_custkey)", "'address'", "''",
        f"concat(c_custkey % 300 + 1, CASE WHEN c_custkey % 9 = 0 THEN 'b' ELSE '' END, ' ', lower(c_mktsegment), ' ', {SUFFIX.format(k='c_custkey')})",
        f"concat(c_custkey % 300 + 1, CASE WHEN c_custkey % 9 = 0 THEN 'b' ELSE '' END, ' ', lower(c_mktsegment), ' ', {SUFFIX.format(k='c_custkey')}, ', Nation ', c_nationkey, ', US')",
        "''", "c_custkey % 53 = 0", "0", "0.0", "''", "concat('nation:', c_nationkey)", "c_custkey + 5000",
    ],
    "part": [
        "concat('part:', p_partkey)", "'street'", "''", f"concat(p_name, ' ', {SUFFIX.format(k='p_partkey % 3')})", "''", "''", "p_partkey % 53 = 0", "0", "0.0", "''", "''", "p_partkey + 9000",
    ],
}

LAT = "24 + CAST(k * 7919 % 26000 AS DOUBLE) / 1000"
LNG = "-125 + CAST(k * 104729 % 59000 AS DOUBLE) / 1000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each area, business, address and street, with coordinates and ``source_key``."""
    out = None
    for name, expressions in SOURCES.items():
        rows = read(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for e, c in zip(expressions, COLUMNS, strict=True)])
        out = rows if out is None else out.unionAll(rows)
    return out.selectExpr(*[c for c in COLUMNS if c != "k"], "k", f"{LAT} AS lat", f"{LNG} AS lng")


RAW_SQL = (
    "raw_places AS (SELECT *, "
    + f"{LAT} AS lat, {LNG} AS lng FROM ("
    + " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {c}" for e, c in zip(expressions, COLUMNS, strict=True)) + f" FROM {name}" for name, expressions in SOURCES.items())
    + "))"
)
