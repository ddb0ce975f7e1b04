"""A durable job table as snapshots and events.

The table's rows are jobs; every operation gives a new snapshot, to be written by the
caller (one writer at a time: foreachBatch of one query). Claims pick each job once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "job_id bigint, run_id bigint, kind string, payload string, state string, priority int, available_at timestamp, "
    "attempts int, max_attempts int, locked_by string, lease_until timestamp, last_error string, updated_at timestamp"
)
READY, LEASED, DONE, FAILED, CANCELLED = "ready", "leased", "done", "failed", "cancelled"
# Families of job kinds, in the order reports show them.
FAMILIES = {"fetch": ("fetch_page",), "enrich": ("enrich_",), "evaluate": ("evaluate_query",), "download": ("download_",)}
#: what enriches each dependency
ENRICHMENT = {
    "comments": ["enrich_comments"], "notes": ["enrich_notes", "enrich_note_versions"], "approvals": ["enrich_post_approvals"],
    "deletion_events": ["enrich_post_flags", "enrich_post_events", "enrich_post_versions"], "pools": ["enrich_pools"],
    "sets": ["enrich_sets"], "replacements": ["enrich_replacements"], "favorites": ["enrich_favorites"], "votes": ["enrich_post_votes"],
}


def refused(new: DataFrame) -> Column:
    """Why a new job cannot be taken, or null."""
    object_ = F.try_parse_json("payload")
    out = F.when(object_.isNull() | ~F.coalesce(F.trim("payload").startswith("{"), F.lit(False)), F.lit("the payload is no JSON object"))
    if "max_attempts" in new.columns:
        out = out.when(F.col("max_attempts") < 1, F.lit("max_attempts must be at least 1"))
    return out.when(F.col("kind").isNull(), F.lit("a job needs a kind"))


def enqueue(jobs: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """new: job_id, kind, payload (JSON text), and optionally run_id, priority, available_at, max_attempts.

    A job that cannot be taken makes the result raise when it is run; refused() tells them beforehand.
    """
    at = F.lit(now)
    have = lambda c, default: F.coalesce(F.col(c), default) if c in new.columns else default
    why = refused(new)
    rows = new.withColumn("payload", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("job "), F.col("job_id").cast("string"), F.lit(": "), why))).otherwise(F.col("payload")))
    rows = rows.select(
        "job_id", have("run_id", F.lit(None)).cast("long").alias("run_id"), "kind", "payload", F.lit(READY).alias("state"),
        have("priority", F.lit(0)).cast("int").alias("priority"), have("available_at", at).cast("timestamp").alias("available_at"),
        F.lit(0).alias("attempts"), have("max_attempts", F.lit(3)).cast("int").alias("max_attempts"),
        F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp").alias("lease_until"),
        F.lit(None).cast("string").alias("last_error"), at.cast("timestamp").alias("updated_at"),
    )
    return jobs.unionByName(rows)


EVENTS = "job_id bigint, event string, message string, at timestamp"


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each job between two snapshots of the table: job_id, event, message, at."""
    old = before.select("job_id", F.col("state").alias("_state"), F.col("attempts").alias("_attempts"), F.col("lease_until").alias("_until"))
    rows = after.join(old, "job_id", "left")
    event = (
        F.when(F.col("_state").isNull(), "enqueued")
        .when((F.col("state") == LEASED) & (F.col("attempts") > F.col("_attempts")), "claimed")
        .when((F.col("state") == LEASED) & (F.col("lease_until") > F.col("_until")), "extended")
        .when((F.col("state") == READY) & (F.col("_state") == LEASED), "retried")
        .when(F.col("state") != F.col("_state"), F.col("state"))
    )
    message = F.when(event.isin("retried", FAILED), F.col("last_error")).when(event == "claimed", F.col("locked_by"))
    return rows.select("job_id", event.alias("event"), message.alias("message"), F.col("updated_at").alias("at")).where("event is not null")


def claimable(now: Column) -> Column:
    """Ready and due, or leased with the lease run out."""
    due = (F.col("state") == READY) & (F.col("available_at") <= now)
    return due | ((F.col("state") == LEASED) & (F.col("lease_until") <= now))


def next_jobs(jobs: DataFrame, now: datetime, n: int, kinds: list[str] | None = None) -> DataFrame:
    """The n jobs to run next: priority, then due time, then id."""
    rows = jobs.where(claimable(F.lit(now)))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.orderBy(F.desc("priority"), "available_at", "job_id").limit(n)


def claim(jobs: DataFrame, now: datetime, worker: str, lease_seconds: int = 600, n: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """The table with the next n jobs leased to the worker."""
    mine = F.broadcast(next_jobs(jobs, now, n, kinds).select("job_id", F.lit(True).alias("_mine")))  # n rows
    taken = F.col("_mine").isNotNull()
    until = F.lit(now) + F.expr(f"interval {lease_seconds} seconds")
    return jobs.join(mine, "job_id", "left").select(
        *(
            {
                "state": F.when(taken, LEASED).otherwise(F.col("state")),
                "attempts": F.col("attempts") + F.when(taken, 1).otherwise(0),
                "locked_by": F.when(taken, worker).otherwise(F.col("locked_by")),
                "lease_until": F.when(taken, until).otherwise(F.col("lease_until")),
                "updated_at": F.when(taken, F.lit(now)).otherwise(F.col("updated_at")),
            }.get(c, F.col(c)).alias(c)
            for c in jobs.columns
        )
    )


def _change(jobs: DataFrame, where: Column, now: datetime, **values) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    types = dict(jobs.dtypes)
    values["updated_at"] = F.lit(now)
    return jobs.select(*((F.when(hit, v).otherwise(F.col(c)).cast(types[c]) if (v := values.get(c)) is not None else F.col(c)).alias(c) for c in jobs.columns))


def _held(job_id: int, worker: str, now: datetime) -> Column:
    return (F.col("job_id") == job_id) & (F.col("state") == LEASED) & (F.col("locked_by") == worker) & (F.col("lease_until") > F.lit(now))


def heartbeat(jobs: DataFrame, job_id: int, worker: str, now: datetime, lease_seconds: int = 600) -> DataFrame:
    """A longer lease, if the worker still holds it."""
    return _change(jobs, _held(job_id, worker, now), now, lease_until=F.lit(now) + F.expr(f"interval {lease_seconds} seconds"))


def complete(jobs: DataFrame, job_id: int, worker: str, now: datetime) -> DataFrame:
    return complete_all(jobs, _held(job_id, worker, now), now)


def complete_all(jobs: DataFrame, where: Column, now: datetime) -> DataFrame:
    none = F.lit(None)
    return _change(jobs, where, now, state=F.lit(DONE), locked_by=none, lease_until=none)


def fail(jobs: DataFrame, job_id: int, worker: str, error: str, now: datetime, retry_seconds: int = 0) -> DataFrame:
    return fail_all(jobs, _held(job_id, worker, now), error, now, retry_seconds)


def fail_all(jobs: DataFrame, where: Column, error: str, now: datetime, retry_seconds: int = 0) -> DataFrame:
    """Ready again while attempts are left, else failed."""
    state = F.when(F.col("attempts") < F.col("max_attempts"), READY).otherwise(FAILED)
    due = F.lit(now) + F.expr(f"interval {retry_seconds} seconds")
    none = F.lit(None)
    return _change(jobs, where, now, state=state, available_at=due, last_error=F.lit(error), locked_by=none, lease_until=none)


def cancel(jobs: DataFrame, where: Column, now: datetime) -> DataFrame:
    return _change(jobs, where & F.col("state").isin(READY, LEASED), now, state=F.lit(CANCELLED))


def cancel_matching(jobs: DataFrame, posts: DataFrame, now: datetime) -> DataFrame:
    """Cancel the open jobs whose payload's post_id is among posts."""
    own = F.get_json_object("payload", "$.post_id").try_cast("bigint")
    ids = posts.select(F.col("post_id").alias("_post")).distinct().withColumn("_hit", F.lit(True))
    rows = jobs.withColumn("_post", own).join(ids, "_post", "left")
    return cancel(rows, F.col("_hit").isNotNull(), now).drop("_post", "_hit")


def family(kind: Column) -> Column:
    out = F.lit("other")
    for name, starts in FAMILIES.items():
        for s in starts:
            out = F.when(kind.startswith(s), name).otherwise(out)
    return out


def metrics(jobs: DataFrame) -> DataFrame:
    """Per run: jobs by state, and the state they add up to."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    out = jobs.groupBy("run_id").agg(F.count("*").alias("jobs"), n(READY, LEASED).alias("pending"), n(DONE).alias("done"), n(FAILED).alias("failed"), n(CANCELLED).alias("cancelled"), F.max("updated_at").alias("updated_at"))
    return out.withColumn("state", F.when(F.col("failed") > 0, "paused").when(F.col("pending") > 0, "pending").otherwise("success"))


def family_counts(jobs: DataFrame) -> DataFrame:
    """place (the families' fixed order, other ones last), family, jobs."""
    place = F.array_position(F.array(*(F.lit(x) for x in (*FAMILIES, "other"))), F.col("family")).cast("int")
    return jobs.groupBy(family(F.col("kind")).alias("family")).agg(F.count("*").alias("jobs")).select(place.alias("place"), "family", "jobs")


def rolling_rate(requests: DataFrame, seconds: int = 10, partition: list[str] | None = None) -> DataFrame:
    """Requests started within the trailing seconds, per second since the first of them (requests: started_at and, by partition, a client).

    Without a partition the hours are apart, each with the seconds before it, so no task gets all requests.
    """
    if not partition:
        hour = F.floor(F.unix_seconds("started_at") / 3600)
        later = F.floor((F.unix_seconds("started_at") + seconds) / 3600)
        own_hour = requests.withColumn("_hour", F.explode(F.array_distinct(F.array(hour, later)))).withColumn("_own", F.col("_hour") == hour)
        return rolling_rate(own_hour, seconds, ["_hour"]).where("_own").drop("_hour", "_own")
    at = F.unix_micros("started_at")
    own = Window.partitionBy(*(partition or [])).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(own)
    elapsed = F.greatest(F.lit(1.0), (at - F.min(at).over(own)) / 1e6)
    return requests.withColumn("in_window", n).withColumn("rate", F.col("in_window") / elapsed)


# enrichment coverage: scope, key, dependency, state


def uncovered(entities: DataFrame, coverage: DataFrame, dependency: str, scope: str = "post") -> DataFrame:
    """Keys of entities (key) without ready or pending coverage."""
    known = coverage.where((F.col("scope") == scope) & (F.col("dependency") == dependency)).select("key")
    return entities.join(known, "key", "left_anti")


def cover(coverage: DataFrame, keys: DataFrame, dependency: str, state: str, scope: str = "post") -> DataFrame:
    """Coverage with the keys in a state."""
    new = keys.select(F.lit(scope).alias("scope"), "key", F.lit(dependency).alias("dependency"), F.lit(state).alias("state")).distinct()
    return coverage.join(new.select("scope", "key", "dependency"), ["scope", "key", "dependency"], "left_anti").unionByName(new)


def fan_out(posts: DataFrame, coverage: DataFrame, needs: set[str], first_id: int = 0) -> DataFrame:
    """Enrichment jobs (job_id, kind, payload) for posts that lack what a query needs."""
    parts = []
    for need in sorted(needs & ENRICHMENT.keys()):
        missing = uncovered(posts.select(F.col("post_id").alias("key")), coverage, need)
        for kind in ENRICHMENT[need]:
            parts.append(missing.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.col("key").alias("post_id"))).alias("payload")))
    if not parts:
        return posts.sparkSession.createDataFrame([], "job_id long, kind string, payload string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # ids need no order, only to be distinct: no global sort
    return out.withColumn("job_id", F.monotonically_increasing_id() + F.lit(first_id)).select("job_id", "kind", "payload")
