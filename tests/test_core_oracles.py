"""Every query that has an SQL oracle agrees with it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tagmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["post_id", "score", "rating"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
