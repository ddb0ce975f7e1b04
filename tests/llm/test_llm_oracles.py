"""The queries that SQL can express agree with it on the smallest tables."""

import os

import duckdb
import pytest

from tagmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]()).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(ours) == plain(theirs)


def test_every_number_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
