import json
from datetime import datetime

import pytest

from tagmill.plans.catalog import Catalog
from tagmill.sources import paged, sidecars
from tagmill.streaming import runs

NOW = datetime(2024, 1, 2)


def lines(spark, *rows):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in rows], "value string")


@pytest.mark.parametrize("name", list(sidecars.ENTITIES))
def test_every_entity_reads_and_merges(spark, name):
    spec = sidecars.ENTITIES[name]
    row = {f.split()[0]: ([1] if "array<bigint>" in f else ["a"] if "array" in f else True if "boolean" in f else "2024-01-01T00:00:00Z" if f.split()[0].endswith("_at") else "x" if "string" in f else 3) for f in spec.fields.split(", ")}
    got = sidecars.parse(lines(spark, row, {"name": "no key"}, "junk"), name)
    assert got.count() == 1 and sidecars.merge(got, got, name).count() == 1 and sidecars.keys(name)


def test_last_row_of_a_key_wins_and_posts_must_exist(spark):
    old = sidecars.parse(lines(spark, {"id": 1, "post_id": 5, "creator_id": 2, "body": "a"}), "comments")
    new = sidecars.parse(lines(spark, {"id": 1, "post_id": 5, "body": "b", "updated_at": "2024-01-02T00:00:00Z"}, {"id": 1, "post_id": 5, "body": "c", "updated_at": "2024-01-03T00:00:00Z"}, {"id": 2, "post_id": 6}), "comments")
    got = sidecars.merge(old, new, "comments", spark.createDataFrame([(5,)], "post_id long"))
    assert [(r.comment_id, r.body) for r in got.collect()] == [(1, "c")]


def test_collections_users_urls(spark):
    pools = sidecars.parse(lines(spark, {"id": 4, "name": "My Pool", "post_ids": [9, 7, 8]}), "pools")
    posts = spark.createDataFrame([(7, ["u"]), (9, ["u", "v"])], "post_id long, sources array<string>")
    assert [(r.post_id, r.sequence) for r in sidecars.members(pools, posts).orderBy("sequence").collect()] == [(9, 0), (7, 1)]
    assert sidecars.hashed_urls(posts).count() == 2 and sidecars.normal_names(pools).first().normalized_name == "my_pool"
    rows = sidecars.parse(lines(spark, {"id": 1, "post_id": 7, "creator_name": "Al "}), "comments")
    users = sidecars.parse(lines(spark, {"id": 3, "name": "AL"}), "users")
    assert sidecars.resolve_users(rows, users).first().user_id == 3
    open_ = sidecars.parse(lines(spark, {"id": 1, "post_id": 7, "status": "Pending"}), "replacements")
    assert {r.post_id: r.pending_replacements for r in sidecars.pending_replacements(posts, open_).collect()} == {7: True, 9: False}


def test_pages_end_with_a_short_one(spark):
    def fetch(resource, page, size):
        return [{"id": k, "r": resource} for k in range(23)][(page - 1) * size : page * size]

    rows = paged.paged(spark, fetch, "posts", size=5, tasks=3).orderBy("page", "place").collect()
    assert [json.loads(r.value)["id"] for r in rows] == list(range(23))
    assert paged.paged(spark, fetch, "posts", size=5, tasks=3, limit=7).count() == 7


def test_runs_and_metadata(spark):
    none = spark.createDataFrame([], runs.RUNS)
    now = runs.complete(runs.start(none, 1, "cat order:score fav:!3", NOW), 1, 7, NOW)
    r = now.first()
    assert (r.state, r.total, json.loads(r.metadata)["needs"]) == ("done", 7, ["favorites", "tags"])
    meta = runs.put(runs.put(spark.createDataFrame([], runs.METADATA), "a", "k", "1"), "a", "k", "2")
    assert [tuple(x) for x in runs.put(meta, "a", "k", "3", keep=True).collect()] == [("a", "k", "2")]
    assert runs.missing_tables(spark, {"posts"})[0] == "tags"


def test_evaluation_leaves_out_what_has_files(spark):
    posts = spark.createDataFrame([(1, 5, False), (2, 9, False), (3, 9, False)], "post_id long, score int, is_deleted boolean")
    got = runs.evaluate("score:>6", Catalog.of(posts), posts, spark.createDataFrame([(3,)], "post_id long"))
    assert [r.post_id for r in got.collect()] == [2]
