from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagmill.functions.scalars import TAG_CATEGORIES
from tagmill.operators.tags import TagGraph
from tagmill.plans.catalog import Catalog
from tagmill.plans.compile import search
from tagmill.plans.explain import canonical

FIELDS = "post_id long, rating string, score int, favcount long, comment_count long, uploader_id long, approver_id long, created_at timestamp, updated_at timestamp, file_ext string, md5 string, width int, height int, file_size long, duration long, parent_post_id long, child_count long, is_deleted boolean, is_pending boolean, is_flagged boolean, rating_locked boolean, note_locked boolean, status_locked boolean, artist_verified boolean, pending_replacements boolean, description string, sources array<string>, all_tags array<string>, tags struct<" + ",".join(f"{c}:array<string>" for c in TAG_CATEGORIES) + ">"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
BASE = dict(rating="s", score=5, favcount=1, comment_count=0, uploader_id=1, created_at=datetime(2026, 5, 1, 4), updated_at=datetime(2026, 5, 2), file_ext="png", width=400, height=300, file_size=250 * 1024, duration=None, child_count=0, is_deleted=False, is_pending=False, is_flagged=False, rating_locked=False, note_locked=False, status_locked=False, artist_verified=None, description="", sources=[])


def post(ident, tags=(), **fields):
    row = {**BASE, **fields, "post_id": ident, "all_tags": list(tags), "tags": {c: list(tags) if c == "general" else [] for c in TAG_CATEGORIES}}
    return tuple(row.get(n) for n in NAMES)


POSTS = [
    post(1, ("lighthouse",), score=150, description="a Calm Sea at dawn", duration=180, md5="0a1b2c3d4e5f60718293a4b5c6d7e8f9"),
    post(2, ("ferry", "Harbour"), rating="e", parent_post_id=9, child_count=2, rating_locked=True, sources=["https://example.org/print", "x"]),
    post(3, ("dinghy",), is_pending=True, favcount=25, file_ext="jpg"),
    post(4, ("storm", "waves"), is_deleted=True, score=None, width=None, height=None),
    post(5, ("sloop", "tall_ship"), is_flagged=True, created_at=datetime(2020, 1, 1), artist_verified=True),
    post(6, (), rating="q", score=-3, width=300, height=400),
]
CASES = [
    # tags, aliases, implications, groups
    ("lighthouse", [1]), ("beacon", [1]), ("vessel", [2, 3, 5]), ("-vessel", [1, 6]), ("( ~boat ~beacon )", [1, 3]), ("vessel -boat", [2, 5]), ("harbour", [2]), ("unseen_tag", []),
    ("-unseen_tag rating:q", [6]), ("storm status:any", [4]), ("storm", []), ("*house", [1]), ("~sloop *house", [1, 5]), ("-*o*", [3, 6]), ("-( vessel -ferry )", [1, 2, 6]), ("~( vessel rating:e ) ~rating:q", [2, 6]),
    # numbers: what is missing does not match, and does match the negation
    ("score:>100", [1]), ("-score:>100 status:any", [2, 3, 4, 5, 6]), ("score:<=5 status:any", [2, 3, 5, 6]), ("favcount:10..100", [3]), ("tagcount:0", [6]), ("gentags:2", [2, 5]), ("arttags:0 tagcount:1", [1, 3]),
    ("ratio:4:3", [1, 2, 3, 5]), ("-ratio:4:3 status:any", [4, 6]), ("width:400 height:300 mpixels:0.12", [1, 2, 3, 5]), ("filesize:200KB..300KB id:1,2", [1, 2]), ("duration:>120", [1]), ("-duration:>120 id:..2", [2]),
    # the rest of a post
    ("rating:explicit", [2]), ("type:jpg", [3]), ("md5:0A1B2C3D4E5F60718293A4B5C6D7E8F9", [1]), ("date:2026-05-01 id:..2", [1, 2]), ("date:2020-01-01", [5]), ("source:*example.org/print", [2]), ("source:*example.org", []),
    ("source:none", [1, 3, 5, 6]), ("hassource:true", [2]), ('description:"calm sea"', [1]), ("hasdescription:true", [1]), ("parent:any", [2]), ("parent:9", [2]), ("child:any", [2]), ("isparent:false ischild:false rating:q", [6]),
    ("locked:rating", [2]), ("-locked:rating", [1, 3, 5, 6]), ("artverified:true", [5]), ("-artverified:true", [1, 2, 3, 6]), ("status:pending", [3]), ("status:active", [1, 2, 6]), ("status:modqueue", [3, 5]), ("status:deleted", [4]),
    ("-status:pending", [1, 2, 5, 6]), ("status:any ( status:deleted )", [4]), ("( ~( status:pending ) ~( status:flagged ) )", [3, 5]), ("-status:deleted", [1, 2, 3, 5, 6]),
    # sidecars, alone and inside or
    ("commenter:Nadia", [1]), ("commenter:Omar", []), ("commenter:!7", [1]), ("-commenter:nadia", [2, 3, 5, 6]), ("~commenter:nadia ~rating:q", [1, 6]), ('note:"calm sea"', [2]), ("votedup:me", [1]), ("voteddown:x", [2]),
    ("voted:x -votedup:x", [2]), ("fav:nadia", [3]), ("noter:nadia", [2]), ("deletedby:nadia", [4]), ("delreason:*bad*", [4]), ("pool:4", [1]), ("pool:tall_and_small_ships", [1]), ("pool:ships", [1]), ("pool:5", []), ("set:harbour_views", [2]),
    ("inpool:true", [1]), ("inpool:false", [2, 3, 5, 6]), ("~inpool:false ~pool:4 status:any", [1, 2, 3, 4, 5, 6]), ("user:nadia", []), ("user:piet", [1, 2, 3, 5, 6]), ("user:me", []), ("fav:me", []),
    ("frobnicate:yes", []), ("-frobnicate:yes rating:q", [6]), ("blacklist:x", []),
]


@pytest.fixture(scope="module")
def graph(spark):
    tags = [("vessel", 1000), ("ferry", 200), ("sloop", 150), ("rowing_boat", 500), ("dinghy", 50), ("lighthouse", 500), ("storm", 500), ("waves", 500), ("never_house", 0)]
    return TagGraph(
        spark.createDataFrame([(n, "general", c) for n, c in tags], "name string, category string, post_count long"),
        spark.createDataFrame([("boat", "rowing_boat", "active", None), ("beacon", "lighthouse", "active", None), ("skiff", "boat", "active", None), ("a", "b", "active", None), ("b", "a", "active", None)], "antecedent string, consequent string, status string, updated_at timestamp"),
        spark.createDataFrame([("ferry", "vessel", "active"), ("sloop", "vessel", "active"), ("rowing_boat", "vessel", "active"), ("dinghy", "rowing_boat", "active"), ("vessel", "ferry", "deleted")], "antecedent string, consequent string, status string"),
    )


@pytest.fixture(scope="module")
def catalog(spark, graph):
    make = spark.createDataFrame
    t = datetime(2026, 1, 1)
    return Catalog.of(
        make(POSTS, FIELDS).cache(),
        {
            "users": make([(7, "Nadia "), (1, "piet"), (8, "omar")], "user_id long, name string"),
            "comments": make([(1, 7, t)], "post_id long, user_id long, created_at timestamp"),
            "notes": make([(2, 8, "such a calm sea", t)], "post_id long, user_id long, body string, created_at timestamp"),
            "note_versions": make([(2, 7)], "post_id long, user_id long"),
            "favorites": make([(3, 7)], "post_id long, user_id long"),
            "votes": make([(1, 7, 1), (2, 7, -1)], "post_id long, user_id long, score int"),
            "deletion_events": make([(4, 7, "a bad reason")], "post_id long, user_id long, reason string"),
            "pools": make([(1, 4, "Tall and Small Ships", "ships")], "post_id long, collection_id long, name string, shortname string"),
            "sets": make([(2, 7, "harbour_views", None)], "post_id long, collection_id long, name string, shortname string"),
        },
        graph,
    )


@pytest.mark.parametrize(("text", "want"), CASES, ids=[c[0] for c in CASES])
def test_search(catalog, text, want):
    assert sorted(r.post_id for r in search(text, catalog, ordered=False).collect()) == want


@pytest.mark.parametrize(("text", "want"), [
    ("", [6, 5, 3, 2, 1]), ("order:id_asc", [1, 2, 3, 5, 6]), ("order:score status:any", [1, 5, 3, 2, 6, 4]), ("-order:score status:any", [4, 6, 2, 3, 5, 1]), ("order:score limit:2", [1, 5]),
    ("order:portrait", [6, 1, 2, 3, 5]), ("order:favcount_asc limit:1", [1]), ("order:tagcount limit:2", [5, 2]), ("order:comment limit:1", [1]), ("order:created limit:4 order:created_asc", [5, 1, 2, 3]),
])
def test_orders(catalog, text, want):
    assert [r.post_id for r in search(text, catalog).collect()] == want


def test_seeded_order_is_stable(catalog):
    rows = lambda seed: [r.post_id for r in search(f"order:random randseed:{seed}", catalog).collect()]
    assert rows(1) == rows(1) and sorted(rows(1)) == [1, 2, 3, 5, 6]


def test_seeds_give_unrelated_orders(spark):
    def kendall(a, b):
        place = {x: k for k, x in enumerate(b)}
        p = [place[x] for x in a]
        n = len(p)
        return sum((p[j] > p[i]) - (p[j] < p[i]) for i in range(n) for j in range(i + 1, n)) * 2 / n / (n - 1)

    ids = [*range(1, 200), *(5 * 10**9 + 17 * k for k in range(200))]
    posts = Catalog.of(spark.createDataFrame([(i, False) for i in ids], "post_id long, is_deleted boolean"))
    orders = [[r.post_id for r in search(f"order:random randseed:{s}", posts).collect()] for s in (0, 1, 123)]
    assert all(sorted(o) == ids for o in orders)
    for a, b in ((0, 1), (1, 2), (0, 2)):
        assert abs(kendall(orders[a], orders[b])) < 0.15


@pytest.mark.parametrize("edges", [False, True])
def test_large_closures_match_without_case(spark, edges):
    """More names than a literal holds: the same answer as for few, in capitals or not."""
    below = [f"Kind_{k}" for k in range(80)]
    graph = TagGraph(
        spark.createDataFrame([(n, "general", 1) for n in ["all", *below]], "name string, category string, post_count long"),
        spark.createDataFrame([], "antecedent string, consequent string, status string, updated_at timestamp"),
        spark.createDataFrame([(n, "all", "active") for n in below], "antecedent string, consequent string, status string"),
    )
    held = {1: ["kind_3"], 2: ["KIND_79"], 3: ["other"], 4: ["All"], 5: []}
    posts = spark.createDataFrame([(p, t, False) for p, t in held.items()], "post_id long, all_tags array<string>, is_deleted boolean")
    rows = spark.createDataFrame([(p, t) for p, x in held.items() for t in x], "post_id long, tag string")
    catalog = Catalog.of(posts, {"post_tags": rows} if edges else {}, graph)
    found = lambda q: sorted(r.post_id for r in search(q, catalog, ordered=False).collect())
    assert found("all") == [1, 2, 4] and found("-all") == [3, 5] and found("~all ~id:5") == [1, 2, 4, 5] and found("all -kind_3") == [2, 4] and found("all kind_3") == [1]


def test_joined_graphs_resolve_like_local_ones(graph, monkeypatch):
    from tagmill.operators import tags as T

    names = ["vessel", "boat", "skiff", "beacon", "a", "b", "dinghy", "nope", "storm"]
    local = TagGraph(graph.tags, graph.aliases, graph.implications)
    local.prefetch(names)
    monkeypatch.setattr(T, "LOCAL_EDGES", 0)
    joined = TagGraph(graph.tags, graph.aliases, graph.implications)
    joined.prefetch(names)
    assert joined.local is None and (joined._names, joined._own) == (local._names, local._own)


def test_closures_beyond_the_driver_stay_a_table(spark, monkeypatch):
    from tagmill.operators import tags as T

    monkeypatch.setattr(T, "MAX_NAMES", 5)
    below = [f"k{k}" for k in range(9)]
    graph = TagGraph(
        spark.createDataFrame([(n, "general", 1) for n in ["all", *below]], "name string, category string, post_count long"),
        spark.createDataFrame([("every", "all", "active", None)], "antecedent string, consequent string, status string, updated_at timestamp"),
        spark.createDataFrame([(n, "all", "active") for n in below], "antecedent string, consequent string, status string"),
    )
    posts = spark.createDataFrame([(1, False), (2, False), (3, False)], "post_id long, is_deleted boolean")
    rows = spark.createDataFrame([(1, "k8"), (2, "all"), (3, "x")], "post_id long, tag string")
    catalog = Catalog.of(posts, {"post_tags": rows}, graph)
    found = lambda q: sorted(r.post_id for r in search(q, catalog, ordered=False).collect())
    assert found("every") == [1, 2] and found("-every") == [3] and found("~every ~x") == [1, 2, 3] and found("every -k8") == [2]
    with pytest.raises(ValueError, match="post_tags"):
        search("every", Catalog.of(posts, {}, graph), ordered=False)


def test_limits_and_viewer(catalog):
    assert search("", catalog, limit=0).count() == 0 and search("limit:1", catalog, limit=3).count() == 3
    assert [r.post_id for r in search("user:me id:..1", catalog, viewer=1).collect()] == [1]
    assert search("votedup:x", catalog, viewer=8).count() == 0


def test_filesize_tolerance(catalog):
    assert search("filesize:246KB", catalog).count() == 0 and search("filesize:246KB", catalog, tolerance=True).count() == 5


@pytest.mark.parametrize("text", [c[0] for c in CASES if "me" not in c[0]][::3] + ["-( fav:nadia -rating:e ) ~note:x ~score:>3", "-( ~commenter:omar ~score:<0 )"])
def test_candidates_hold_all_results(catalog, text):
    bare = Catalog(catalog.posts, {}, catalog.tags)
    exact = {r.post_id for r in search(text, catalog, ordered=False).collect()}
    assert exact <= {r.post_id for r in search(text, bare, candidate=True, ordered=False).collect()}


def test_graph(graph):
    assert sorted(map(tuple, graph.closed.collect())) == [("dinghy", "rowing_boat", 1), ("dinghy", "vessel", 2), ("ferry", "vessel", 1), ("rowing_boat", "vessel", 1), ("sloop", "vessel", 1)]
    assert graph.resolve("skiff") == ("rowing_boat", True) and graph.resolve("nope") == ("nope", False)
    assert graph.expand("*house", 1) == (["lighthouse"], False) and graph.expand("s*", 1)[1]
    assert canonical("beacon -( skiff sloop ) score:1", graph) == "lighthouse -( rowing_boat sloop ) score:1"
    assert graph.report()["ready"] and graph.report()["closure"] == 5


def test_cycles_end(spark):
    from tagmill.operators.tags import canonical_aliases, closure

    edges = spark.createDataFrame([("a", "b", "active"), ("b", "a", "active"), ("b", "c", "active")], "antecedent string, consequent string, status string")
    assert sorted(map(tuple, closure(edges).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 1)]
    got = {r.antecedent: r.canonical for r in canonical_aliases(edges.withColumn("updated_at", F.lit(None).cast("timestamp")).where("consequent <> 'c'")).collect()}
    assert got == {"a": "b", "b": "a"}


def test_filters_reach_the_scan(spark):
    from tagmill.sources.star import Star

    plan = search("score:>3 rating:s", Star(spark, "/root/testdata/sf0.001").catalog(), ordered=False)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "o_comment" not in plan and "PushedFilters" in plan
