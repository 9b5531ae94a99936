"""Every query against another engine on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def values(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        return float(x) if isinstance(x, float) else int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_other_engine(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_paths_hold_when_checked_from_their_edges(spark):
    rows = QUERIES["path_verify"](spark, SF).collect()
    assert rows and all(r.continuous and r.cheapest for r in rows)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
