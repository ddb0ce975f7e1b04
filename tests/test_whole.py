import re

import pytest

from tagmill.operators import tags as T
from tagmill.queries import QUERIES
from tagmill.sources.star import Star

SF = "/root/testdata/sf0.001"


def test_no_pool_owner_or_post_is_left_out(spark):
    star = Star(spark, SF)
    assert QUERIES["pool_order"](spark, SF).count() == star.table("lineitem").count()
    assert QUERIES["embedded_ids_join"](spark, SF).count() == star.table("orders").count()
    assert QUERIES["job_fan_out"](spark, SF).count() == 2 * star.own().where("post_id % 2 = 1").count()


def test_tags_of_every_category_are_returned(spark):
    out = QUERIES["implied_membership"](spark, SF)
    assert Star(spark, SF).post_tags().join(out, ["post_id", "tag"], "left_anti").count() == 0


def joins_of_parts(df):
    return set(re.findall(r"(\w+Join) \[l_partkey", df._jdf.queryExecution().sparkPlan().toString()))


@pytest.mark.parametrize("name", ["tags_of_posts", "implied_membership"])
def test_the_parts_are_not_broadcast(spark, name):
    """At 60 times sf0.1 the driver cannot hold them, and Spark takes them for small all the same."""
    assert joins_of_parts(QUERIES[name](spark, SF)) == {"SortMergeJoin"}
    assert joins_of_parts(Star(spark, SF).tags()) == {"SortMergeJoin"}


def test_tags_come_out_once_whether_broadcast_or_not(spark, monkeypatch):
    edges = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "x"), (1, "c"), (2, "c")], "post_id long, tag string")
    tags = spark.createDataFrame([("a", "general"), ("b", "general"), ("c", "species")], "name string, category string")
    for most in (T.MAX_BROADCAST_ROWS, 2):
        monkeypatch.setattr(T, "MAX_BROADCAST_ROWS", most)
        rows = T.tags_of_posts(edges, tags).collect()
        assert sorted(map(tuple, rows)) == [(1, "general", ["a", "b"]), (1, "species", ["c"]), (2, "species", ["c"])]
