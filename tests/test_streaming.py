import json
from datetime import datetime, timedelta

import pytest

from tagmill.operators.state import cut
from tagmill.sources.export import read_store, write_store
from tagmill.sources.snapshot import accepted, from_payloads
from tagmill.streaming import events, jobs

T0 = datetime(2024, 1, 1, 12)


@pytest.fixture
def table(spark):
    new = spark.createDataFrame([(1, "fetch_page", "{}", 0, 2), (2, "enrich_notes", '{"post_id": 5}', 9, 1), (3, "download_sample", '{"post_id": 6}', 9, 1)], "job_id long, kind string, payload string, priority int, max_attempts int")
    return jobs.enqueue(spark.createDataFrame([], jobs.SCHEMA), new, T0)


def by_id(df):
    return {r.job_id: r for r in df.collect()}


@pytest.mark.parametrize(("kind", "payload", "attempts", "why"), [("x", "{bad", 1, "no JSON object"), ("x", "[1]", 1, "no JSON object"), ("x", None, 1, "no JSON object"), ("x", "{}", 0, "max_attempts"), (None, "{}", 1, "a kind")])
def test_jobs_that_cannot_be_taken_raise(spark, table, kind, payload, attempts, why):
    new = spark.createDataFrame([(8, kind, payload, attempts)], "job_id long, kind string, payload string, max_attempts int")
    assert why in new.select(jobs.refused(new)).first()[0]
    with pytest.raises(Exception, match=why):
        jobs.enqueue(table, new, T0).collect()


def test_snapshots_tell_events(spark, table):
    none = spark.createDataFrame([], jobs.SCHEMA)
    steps = [none, table]
    steps.append(cut(jobs.claim(steps[-1], T0, "w", n=2)))
    steps.append(cut(jobs.heartbeat(steps[-1], 2, "w", T0 + timedelta(seconds=5), 900)))
    steps.append(cut(jobs.complete(steps[-1], 2, "w", T0 + timedelta(seconds=9))))
    steps.append(cut(jobs.fail(steps[-1], 3, "w", "gone", T0 + timedelta(seconds=9))))
    seen = [sorted((r.job_id, r.event, r.message) for r in jobs.events(a, b).collect()) for a, b in zip(steps, steps[1:], strict=False)]
    assert seen == [[(k, "enqueued", None) for k in (1, 2, 3)], [(2, "claimed", "w"), (3, "claimed", "w")], [(2, "extended", None)], [(2, "done", None)], [(3, "failed", "gone")]]


def test_runner_follows_jobs_until_none_is_due(spark, tmp_path):
    from tagmill.streaming.runner import Runner

    at, calls = {"now": T0}, []

    def page(rows):
        calls.append(("page", rows.count()))
        return rows.sparkSession.createDataFrame([("evaluate_query", '{"k":1}'), ("broken", "{}")], "kind string, payload string")

    def evaluate(rows):
        calls.append(("evaluate", rows.count()))

    def broken(rows):
        calls.append(("broken", rows.count()))
        raise RuntimeError("no such thing\nat all")

    runner = Runner(spark, str(tmp_path / "jobs"), {"fetch_page": page, "evaluate_query": evaluate, "broken": broken}, now=lambda: at["now"])
    runner.start(spark.createDataFrame([(1, "fetch_page", "{}"), (2, "fetch_page", "{}"), (3, "unknown", "{}")], "job_id long, kind string, payload string"))
    assert runner.run_until_empty() == 4 and calls == [("page", 2), ("broken", 1), ("evaluate", 1)]
    for _ in range(2):
        at["now"] += timedelta(seconds=31)
        assert runner.run_until_empty() == 1
    states = {r.kind: (r.state, r.attempts, r.last_error) for r in runner.table().collect()}
    assert states == {"fetch_page": ("done", 1, None), "evaluate_query": ("done", 1, None), "broken": ("failed", 3, "RuntimeError: no such thing"), "unknown": ("ready", 0, None)}
    log = sorted((r.job_id, r.event) for r in runner.log().collect() if r.job_id in (1, 4))
    assert log == [(1, "claimed"), (1, "done"), (1, "enqueued"), (4, "claimed"), (4, "claimed"), (4, "claimed"), (4, "enqueued"), (4, "failed"), (4, "retried"), (4, "retried")]


def test_files_are_wanted_claimed_and_there(spark):
    from tagmill.streaming import files

    none = spark.createDataFrame([], files.SCHEMA)
    wanted = spark.createDataFrame([(1, "sample", "png", "u1", "aa"), (2, "sample", None, "u2", "bb"), (2, "original", "gif", "u3", "cc")], "post_id long, variant string, ext string, source_url string, md5 string")
    table = cut(files.want(none, wanted, T0))
    assert [(r.post_id, r.variant) for r in files.pending(table, 5).collect()] == [(1, "sample"), (2, "original"), (2, "sample")]
    later = T0 + timedelta(seconds=5)
    table = cut(files.claim(table, later, 1, "sample"))
    done = spark.createDataFrame([(1, "sample", "/f/1.png", 12, "AB")], "post_id long, variant string, local_path string, bytes_written long, checksum string")
    table = cut(files.failed(files.fetched(table, done, later), wanted.where("variant = 'original'"), later))
    assert {(r.post_id, r.variant): (r.state, r.local_path, r.checksum) for r in table.collect()} == {(1, "sample"): ("downloaded", "/f/1.png", "ab"), (2, "sample"): ("pending", "files/000000000002/sample.bin", None), (2, "original"): ("failed", "files/000000000002/original.gif", None)}
    again = cut(files.want(table, wanted, later))
    assert [r.post_id for r in files.there(again, "sample").collect()] == [1] and {(r.variant, r.state): r.files for r in files.counts(again).collect()}["original", "pending"] == 1
    with pytest.raises(Exception, match="negative"):
        files.fetched(table, done.withColumn("bytes_written", done["bytes_written"] - 20), later).collect()
    with pytest.raises(ValueError):
        files.pending(table, 0)


def test_pages_lead_to_jobs(spark):
    from tagmill.plans.catalog import Catalog
    from tagmill.streaming import files, pages

    page = lambda posts, left: spark.createDataFrame([("q", 3, 100, left, posts)], "query string, page int, page_size int, remaining int, posts int")
    got = [[tuple(r) for r in pages.next_page(page(*x)).collect()] for x in ((100, None), (99, None), (100, 130), (100, 100))]
    assert got == [[("q", 4, 100, None)], [], [("q", 4, 30, 30)], []]
    posts = spark.createDataFrame([(5,), (9,)], "post_id long")
    covered = jobs.cover(spark.createDataFrame([], "scope string, key long, dependency string, state string"), spark.createDataFrame([(5,)], "key long"), "notes", "ready")
    rows = sorted((r.priority, r.kind, r.payload) for r in pages.after_page(page(100, None), posts, covered, "note:x").collect())
    assert rows == [(5, "evaluate_query", '{"query":"note:x","post_ids":[5,9]}'), (20, "enrich_note_versions", '{"post_id":9}'), (20, "enrich_notes", '{"post_id":9}'), (30, "fetch_page", '{"query":"q","page":4,"page_size":100}')]
    own = spark.createDataFrame([(5, "s", False), (9, "q", False)], "post_id long, rating string, is_deleted boolean")
    files_of = spark.createDataFrame([(5, "png", "u5", "aa"), (9, "png", "u9", "bb")], "post_id long, ext string, source_url string, md5 string")
    table, new = pages.downloads("rating:s", Catalog.of(own), files_of, spark.createDataFrame([], files.SCHEMA), "sample", T0)
    assert [(r.post_id, r.state) for r in table.collect()] == [(5, "pending")]
    assert [(r.kind, json.loads(r.payload)["destination"]) for r in new.collect()] == [("download_sample", "files/000000000005/sample.png")]


def test_runs_are_listed_and_fail(spark):
    from tagmill.streaming import runs

    table = spark.createDataFrame([], runs.RUNS)
    for k in (1, 2):
        table = cut(runs.start(table, k, f"score:>{k}", T0 + timedelta(seconds=k)))
    table = cut(runs.fail(table, 1, "boom", T0 + timedelta(seconds=9)))
    assert [r.run_id for r in runs.listed(table).collect()] == [1, 2] and [r.run_id for r in runs.listed(table, "running").collect()] == [2]
    assert runs.get(table, 1).state == "failed" and "boom" in runs.get(table, 1).metadata
    with pytest.raises(KeyError):
        runs.get(table, 7)


def test_rate_without_a_partition_is_the_same(spark):
    at = [T0 + timedelta(seconds=s) for s in (-3605, -3598, -5, 0, 3, 3599, 3601, 7300)]
    rows = spark.createDataFrame([(t, "a") for t in at], "started_at timestamp, client string")
    got = [sorted((r.started_at, r.in_window, r.rate) for r in jobs.rolling_rate(rows, 10, p).collect()) for p in (None, ["client"])]
    assert got[0] == got[1]


def test_claims_go_by_priority_and_leases_run_out(table):
    now = cut(jobs.claim(table, T0, "w1", 60))
    assert by_id(now)[2].locked_by == "w1" and by_id(now)[2].attempts == 1
    now = cut(jobs.claim(now, T0, "w2", 60))
    assert by_id(now)[3].locked_by == "w2"
    later = T0 + timedelta(seconds=61)
    now = cut(jobs.heartbeat(now, 3, "w2", T0 + timedelta(seconds=30), 600))
    now = cut(jobs.claim(now, later, "w3", 60))
    assert by_id(now)[2].locked_by == "w3" and by_id(now)[3].locked_by == "w2"
    # a lost lease cannot be completed
    assert by_id(jobs.complete(now, 2, "w1", later))[2].state == "leased"
    assert by_id(jobs.complete(now, 2, "w3", later))[2].state == "done"


def test_failures_retry_until_attempts_run_out(table):
    now = cut(jobs.claim(table, T0, "w", kinds=["fetch_page"]))
    now = cut(jobs.fail(now, 1, "w", "boom", T0, 30))
    assert by_id(now)[1].state == "ready" and by_id(now)[1].last_error == "boom"
    assert jobs.next_jobs(now, T0, 5, ["fetch_page"]).count() == 0
    later = T0 + timedelta(seconds=31)
    now = cut(jobs.fail(jobs.claim(now, later, "w", kinds=["fetch_page"]), 1, "w", "boom", later))
    assert by_id(now)[1].state == "failed"
    assert jobs.metrics(now).first().state == "paused"


def test_cancel_by_posts(spark, table):
    hit = spark.createDataFrame([(6,)], "post_id long")
    assert {k: r.state for k, r in by_id(jobs.cancel_matching(table, hit, T0)).items()} == {1: "ready", 2: "ready", 3: "cancelled"}


def test_coverage_and_fan_out(spark):
    posts = spark.createDataFrame([(1,), (2,)], "post_id long")
    none = spark.createDataFrame([], "scope string, key long, dependency string, state string")
    covered = jobs.cover(none, spark.createDataFrame([(1,)], "key long"), "deletion_events", "ready")
    out = jobs.fan_out(posts, covered, {"deletion_events", "users"})
    assert sorted((r.kind, r.payload) for r in out.collect()) == [(k, '{"post_id":2}') for k in sorted(jobs.ENRICHMENT["deletion_events"])]
    assert out.select("job_id").distinct().count() == 3 and jobs.fan_out(posts, covered, set()).count() == 0


def test_rolling_rate(spark):
    rows = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in (0, 1, 5, 20)], "started_at timestamp")
    assert [(r.in_window, r.rate) for r in jobs.rolling_rate(rows, 10).orderBy("started_at").collect()] == [(1, 1.0), (2, 2.0), (3, 0.6), (1, 1.0)]


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    line = lambda i, score, day: json.dumps({"id": i, "rating": "s", "file": {"ext": "png"}, "score": {"total": score}, "updated_at": f"2024-01-0{day}T00:00:00Z"})
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    empty = accepted(from_payloads(spark.createDataFrame([], "value string")))
    write_store(empty, f"{store}/0", 0)
    state = {"at": 0}

    def write(rows, number):
        write_store(rows, f"{store}/{number + 1}", number + 1)
        state["at"] = number + 1

    for k, text in enumerate([f"{line(1, 1, 1)}\n{line(2, 1, 1)}", f"{line(1, 9, 3)}\n{line(1, 5, 2)}\nbroken"]):
        (source / f"{k}.txt").write_text(text)
        lines = spark.readStream.text(str(source))
        events.ingest(spark, lines, str(tmp_path / "ck"), lambda: read_store(spark, f"{store}/{state['at']}"), write).start().awaitTermination(120)
    assert sorted((r.post_id, r.score) for r in read_store(spark, f"{store}/{state['at']}").collect()) == [(1, 9), (2, 1)]


def test_standing_search_and_windows(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=10 * i), i % 2, "view" if i % 3 else "click", float(i)) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "e"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    source = events.stream(spark, str(tmp_path / "e"), schema)
    q = events.windowed(source).writeStream.outputMode("complete").format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("w1").collect()) == 30
    posts = events.stream(spark, str(tmp_path / "e"), schema).selectExpr("event_id as post_id", "cast(value as int) as score", "false as is_deleted")
    q = events.standing_search(posts, "score:>=25").writeStream.format("memory").queryName("w2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.post_id for r in spark.table("w2").collect()) == [25, 26, 27, 28, 29]
    with pytest.raises(ValueError):
        events.standing_search(posts, "inpool:true")
