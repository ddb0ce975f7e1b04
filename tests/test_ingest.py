import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.operators import merge
from tagmill.sources import export, snapshot


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("2020-01-01 00:00:00+00", datetime(2020, 1, 1)), ("2020-01-01 01:02:03.06082+00", datetime(2020, 1, 1, 1, 2, 3, 60820)), ("2026-05-01T00:00:00.000-04:00", datetime(2026, 5, 1, 4)), ("2020-01-01T00:00:00Z", datetime(2020, 1, 1)), ("2020-01-01 05:00:00", datetime(2020, 1, 1, 5)), ("x", None), (None, None)])
def test_instants(spark, text, want):
    assert one(spark, S.instant, text) == want


def test_scalars(spark):
    assert one(spark, S.normal_tag, "  Red  Panda\t") == "red_panda" and one(spark, S.normal_tag, " \x01 ") is None
    assert one(spark, S.tag_list, " a B a ") == ["a", "b"] and one(spark, S.lines, "a\n\n b\r\nc") == ["a", "b", "c"]
    assert [one(spark, S.id_list, x) for x in ("{1,2}", "1 2", "1,2", "", None)] == [[1, 2], [1, 2], [1, 2], [], []]
    assert [one(spark, S.whole, x) for x in ("88.25", "-6", "x")] == [88, -6, None] and one(spark, S.count_of, "-1") == 0
    assert [one(spark, S.truthy, x) for x in ("t", "YES", "1", "f", None)] == [True, True, True, False, False]
    assert one(spark, S.url_extension, "https://x/y/a.PNG?b=c.d") == "png" and one(spark, S.alias_status, "weird") == "active"
    assert one(spark, lambda x: S.flag(x, "rating_locked"), 8, "int") is True and one(spark, S.human_bytes, 1536, "long") == "1.5 KB"
    assert [one(spark, S.human_count, x, "long") for x in (950, 1200, 3_400_000)] == ["950", "1.2k", "3.4M"]
    assert [one(spark, S.human_duration, x, "long") for x in (65, 3725)] == ["1:05", "1:02:05"]
    assert S.glob_regex("a.*?") == r"(?s)^a\..*.$"


def test_csv_snapshot(spark, tmp_path):
    text = 'id,rating,tag_string,score,fav_count,comment_count,duration,is_deleted,created_at,source,description\n1,s,"a b a",5,2,-1,154.58,f,2020-01-01 00:00:00+00,"http://x\nhttp://y","say ""hi"""\n,,,,,,,,,,\n2,z,a,1,1,1,,t,2020-01-01 00:00:00+00,,\nx,s,a,1,1,1,,t,,,\n'
    with gzip.open(tmp_path / "posts-2024-01-01.csv.gz", "wt") as f:
        f.write(text)
    rows = snapshot.parse_posts(snapshot.read_csv(spark, str(tmp_path / "posts-2024-01-01.csv.gz"))).cache()
    good = snapshot.accepted(rows).collect()
    assert [(r.post_id, r.all_tags, r.comment_count, r.duration, r.is_deleted, r.sources, r.description) for r in good] == [(1, ["a", "b"], 0, 154, False, ["http://x", "http://y"], 'say "hi"')]
    assert {r.reason for r in snapshot.rejections(rows).collect()} == {"rating is unknown", "post id is no number"}
    tags = spark.createDataFrame([("a", "general")], "name string, category string")
    assert [tuple(r) for r in snapshot.unknown_tags(snapshot.accepted(rows), tags).collect()] == [("b", 1)]
    staged = spark.createDataFrame([("a", "artist"), ("n", "meta")], "name string, category string")
    assert sorted(map(tuple, snapshot.merged_tags(tags, staged).collect())) == [("a", "general"), ("n", "meta")]


def test_tag_and_edge_files(spark):
    raw = spark.createDataFrame([("1", "Red Panda", "5", "10", "f"), ("2", " \x02 ", "0", "1", None)], "id string, name string, category string, post_count string, is_deprecated string")
    assert [tuple(r) for r in snapshot.parse_tags(raw).collect()] == [(1, "red_panda", "species", 10, False)]
    with pytest.raises(Exception, match="no number"):
        snapshot.parse_tags(raw.withColumn("id", F.lit("x"))).collect()
    edges = spark.createDataFrame([("A b", "c", "odd")], "antecedent_name string, consequent_name string, status string")
    assert [tuple(r) for r in snapshot.parse_edges(edges).collect()] == [("a_b", "c", "active", None)]
    pools = snapshot.parse_pools(spark.createDataFrame([("3", "My Pool", "{9,4}", "Series")], "id string, name string, post_ids string, category string"))
    members = merge.existing_only(snapshot.pool_posts(pools), spark.createDataFrame([(4,)], "post_id long"))
    assert [(r.collection_id, r.sequence, r.post_id) for r in members.collect()] == [(3, 1, 4)]


def test_payloads(spark):
    good = '{"post":{"id":7,"rating":"s","file":{"ext":"png","width":2},"score":{"total":3},"tags":{"general":["A","b"],"artist":["b"]},"comment_count":-1,"sources":["x",""],"flags":{"deleted":true}}}'
    lines = spark.createDataFrame([(good,), ('{"id":8,"rating":"s"}',), ('{"id":"x","rating":"s","file":{}}',), ("junk",), ('{"id":9,"rating":"?","file":{"ext":"a"}}',)], "value string")
    rows = snapshot.from_payloads(lines).cache()
    r = snapshot.accepted(rows).first()
    assert (r.post_id, r.all_tags, r.comment_count, r.sources, r.is_deleted, r.score) == (7, ["a", "b"], 0, ["x"], True, 3)
    assert sorted(x.reason for x in snapshot.rejections(rows).collect()) == ["file is missing", "post id is no number", "post id is no number", "rating is unknown"]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, s long")
    got = merge.upsert(old, new, ["k"], "s")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, merge.upsert(got, new, ["k"], "s").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p long, t string")
    assert sorted(map(tuple, merge.replace_edges(edges, spark.createDataFrame([(1, "n")], "p long, t string"), "p").collect())) == [(1, "n"), (2, "c")]
    assert merge.replace_edges(edges, edges.limit(0), "p", edges.where("p = 1")).count() == 1


def test_dates_and_store(spark, tmp_path):
    files = snapshot.file_dates(["tags-2024-01-01.csv.gz", "posts-2024-01-02.csv.gz", "tags-2024-01-02.csv.gz", "junk"])
    df = spark.createDataFrame(files, "kind string, date string")
    assert snapshot.latest_shared(df, ("tags", "posts")).first().date == "2024-01-02"
    rows = spark.createDataFrame([(1, "s")], "post_id long, rating string")
    export.write_store(rows, str(tmp_path / "s"), 3)
    assert export.read_store(spark, str(tmp_path / "s")).count() == 1
    assert export.documents(rows).first().json == '{"post_id":1,"rating":"s"}'
    export.write_store({"data": rows.union(rows), "more": rows}, str(tmp_path / "s"), 4)
    assert export.read_store(spark, str(tmp_path / "s")).count() == 2 and export.manifest(spark, str(tmp_path / "s"))["counts"] == {"data": 2, "more": 1}
    # a generation without a manifest, or of another version, is not the store's
    rows.write.parquet(str(tmp_path / "s/data-5"))
    spark.createDataFrame([('{"schema_version": 0, "status": "ready", "generation": 6}',)], "value string").write.text(str(tmp_path / "s/manifest-6"))
    assert export.read_store(spark, str(tmp_path / "s"), "more").count() == 1
    for path in ("none", "s/data-5"):
        with pytest.raises(ValueError, match="not readable"):
            export.read_store(spark, str(tmp_path / path))
    links = export.links(rows, spark.createDataFrame([(1, "sample", "png", "/a"), (2, "sample", "png", "/b")], "post_id long, variant string, ext string, local_path string"))
    assert [tuple(r) for r in links.collect()] == [(1, "000000000001/sample.png", "/a")]


def test_a_payload_is_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    rows = snapshot.accepted(snapshot.from_payloads(lines)).select("post_id", "rating", "score", "favcount")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan


def test_wiki_pages(spark):
    raw = spark.createDataFrame([("4", " Tall Ship ", None, "t", "2024-01-01 00:00:00+00", None), ("x", "a", "b", "f", None, None), ("5", " ", "b", "f", None, None)], "id string, title string, body string, is_locked string, created_at string, updated_at string")
    assert [tuple(r)[:4] for r in snapshot.parse_wiki_pages(raw).collect()] == [(4, "tall_ship", "", True)]


def test_packed_ids(spark):
    ids = spark.createDataFrame([([5, 1, 5, 4294967295],), ([],)], "x array<bigint>").select(S.pack_ids(F.col("x")).alias("p"))
    packed = [bytes(r.p) for r in ids.collect()]
    assert packed == [bytes([1, 0, 0, 0, 5, 0, 0, 0, 255, 255, 255, 255]), b""]
    assert [r.y for r in ids.select(S.unpack_ids(F.col("p")).alias("y")).collect()] == [[1, 5, 4294967295], []]
    assert one(spark, S.unpack_ids, None, "binary") == []
    with pytest.raises(Exception, match="divisible by 4"):
        one(spark, S.unpack_ids, b"abc", "binary")


def test_tag_ids(spark):
    from tagmill.operators import tags as T

    tags = spark.createDataFrame([("a", 7), ("b", 3)], "name string, tag_id long")
    assert [tuple(r) for r in T.ids_of(spark.createDataFrame([(" A",), ("a",), ("x",)], "name string"), tags).collect()] == [("a", 7)]
    rows = T.packed_tags(spark.createDataFrame([(1, "b"), (1, "a"), (1, "x")], "post_id long, tag string"), tags).collect()
    assert [(r.post_id, bytes(r.tag_ids)) for r in rows] == [(1, bytes([3, 0, 0, 0, 7, 0, 0, 0]))]


def test_collections_replace_all_their_members(spark):
    from tagmill.sources import sidecars

    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    first = sidecars.parse(lines('{"id":1,"name":"A","post_ids":[5,6],"updated_at":"2024-01-01T00:00:00Z"}', '{"id":2,"name":"B","post_ids":[7]}'), "pools")
    again = sidecars.parse(lines('{"id":1,"name":"A2","post_ids":[9,6],"updated_at":"2024-01-03T00:00:00Z"}', '{"id":1,"name":"old","post_ids":[1],"updated_at":"2024-01-02T00:00:00Z"}', '{"id":3,"name":"C"}'), "pools")
    pools, edges = sidecars.upsert_collections(first, sidecars.members(first), again, "pools", spark.createDataFrame([(5,), (6,), (7,)], "post_id long"))
    assert sorted((r.collection_id, r.name) for r in pools.collect()) == [(1, "A2"), (2, "B"), (3, "C")]
    assert sorted((r.collection_id, r.sequence, r.post_id) for r in edges.collect()) == [(1, 1, 6), (2, 0, 7)]


def test_own_metatags(spark, monkeypatch):
    from tagmill.lang import bind
    from tagmill.plans.catalog import Catalog
    from tagmill.plans.compile import search

    monkeypatch.setattr(bind, "OWN", {})
    bind.register("even", lambda text: {"yes": 0, "no": 1}[text] if text in ("yes", "no") else int("x"), lambda v: F.col("post_id") % 2 == v, ("post_id",))
    posts = Catalog.of(spark.createDataFrame([(1, False), (2, False), (None, False)], "post_id long, is_deleted boolean"))
    ids = lambda q: [r.post_id for r in search(q, posts, ordered=False).collect()]
    assert ids("even:yes") == [2] and ids("-even:yes") == [1, None] and not bind.bind("even:maybe").ok
