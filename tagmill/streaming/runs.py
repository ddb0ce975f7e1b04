"""Query runs and key-value metadata as small tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.lang.bind import bind
from tagmill.operators.merge import upsert
from tagmill.plans.catalog import Catalog
from tagmill.plans.compile import search
from tagmill.plans.explain import canonical, explain

RUNS = "run_id bigint, query string, canonical string, state string, metadata string, total bigint, started_at timestamp, updated_at timestamp"
METADATA = "namespace string, key string, value string"
TABLES = ("posts", "tags", "tag_aliases", "tag_implications", "users", "comments", "notes", "favorites", "votes", "pools", "sets", "jobs", "coverage")


def start(runs: DataFrame, run_id: int, text: str, now: datetime, tags=None) -> DataFrame:
    """A run of a query: its canonical text, what it needs, its options."""
    q = bind(text, tags, now).checked()
    data = explain(text, tags, now)
    meta = json.dumps({"needs": sorted(q.needs), "options": data["query_options"]}, sort_keys=True)
    row = [(run_id, text, canonical(text, tags) if tags else text, "running", meta, None, now, now)]
    return upsert(runs, runs.sparkSession.createDataFrame(row, RUNS).withColumn("_seq", F.lit(0)), ["run_id"], "_seq")


def change(runs: DataFrame, run_id: int, now: datetime, **values) -> DataFrame:
    hit = F.col("run_id") == run_id
    types = dict(runs.dtypes)
    values["updated_at"] = now
    return runs.select(*((F.when(hit, F.lit(values[c]).cast(types[c])).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in runs.columns))


def complete(runs: DataFrame, run_id: int, total: int, now: datetime) -> DataFrame:
    return change(runs, run_id, now, state="done", total=total)


def fail(runs: DataFrame, run_id: int, error: str, now: datetime) -> DataFrame:
    return change(runs, run_id, now, state="failed", metadata=json.dumps({"error": error}))


def get(runs: DataFrame, run_id: int):
    """The run's row; KeyError if there is none."""
    row = runs.where(F.col("run_id") == run_id).first()
    if row is None:
        raise KeyError(run_id)
    return row


def listed(runs: DataFrame, state: str | None = None) -> DataFrame:
    """All runs, or those of a state, the last changed first."""
    return (runs.where(F.col("state") == state) if state else runs).orderBy(F.desc("updated_at"), F.desc("run_id"))


def put(metadata: DataFrame, namespace: str, key: str, value: str, keep: bool = False) -> DataFrame:
    """The key set to a value; keep: only if it is not there."""
    new = metadata.sparkSession.createDataFrame([(namespace, key, value)], METADATA)
    if keep:
        return metadata.unionByName(new.join(metadata, ["namespace", "key"], "left_anti"))
    return metadata.join(new, ["namespace", "key"], "left_anti").select(*metadata.columns).unionByName(new)


def missing_tables(spark: SparkSession, present: set[str], required: tuple[str, ...] = TABLES) -> list[str]:
    """Which required tables a storage lacks."""
    return [t for t in required if t not in present]


def evaluate(text: str, catalog: Catalog, posts: DataFrame, files: DataFrame, now: datetime | None = None) -> DataFrame:
    """Of given posts, those that match the query and have no file yet (files: post_id): what to download."""
    hits = posts.select("post_id").join(search(text, catalog, now=now, ordered=False), "post_id", "left_semi")
    return hits.join(files.select("post_id").distinct(), "post_id", "left_anti")
