"""Entities beside posts: JSON rows, validated and merged by key.

Each entity has the fields it is read with, the key it is merged by and the canonical
columns that searches use (post_id, user_id, created_at, score, body, reason,
collection_id, name). Rows without their key or post are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.operators.merge import latest, upsert


@dataclass(frozen=True)
class Entity:
    fields: str
    key: tuple[str, ...]
    columns: dict[str, str]  # canonical column: SQL over the fields
    sequence: str = "updated_at"


_WHEN = "created_at string, updated_at string"
_AT = {"created_at": "try_to_timestamp(created_at)", "updated_at": "coalesce(try_to_timestamp(updated_at), try_to_timestamp(created_at))"}
_NAME = "lower(trim({}))"
# The entities' names and the field names of their payloads.
ENTITIES = {
    "comments": Entity(f"id bigint, post_id bigint, creator_id bigint, creator_name string, body string, score int, is_hidden boolean, do_not_bump_post boolean, {_WHEN}", ("id", "post_id"), {"comment_id": "id", "post_id": "post_id", "user_id": "creator_id", "user_name": _NAME.format("creator_name"), "body": "body", "score": "score", "bumps": "not coalesce(do_not_bump_post, false)", **_AT}),
    "notes": Entity(f"id bigint, post_id bigint, creator_id bigint, x int, y int, width int, height int, body string, is_active boolean, {_WHEN}", ("id", "post_id"), {"note_id": "id", "post_id": "post_id", "user_id": "creator_id", "x": "x", "y": "y", "width": "width", "height": "height", "body": "body", **_AT}),
    "note_versions": Entity(f"id bigint, note_id bigint, post_id bigint, updater_id bigint, body string, {_WHEN}", ("id", "post_id"), {"version_id": "id", "note_id": "note_id", "post_id": "post_id", "user_id": "updater_id", "body": "body", **_AT}),
    "favorites": Entity(f"post_id bigint, user_id bigint, {_WHEN}", ("post_id", "user_id"), {"post_id": "post_id", "user_id": "user_id", **_AT}),
    "votes": Entity(f"post_id bigint, user_id bigint, score int, {_WHEN}", ("post_id", "user_id"), {"post_id": "post_id", "user_id": "user_id", "score": "score", **_AT}),
    "flags": Entity(f"id bigint, post_id bigint, creator_id bigint, reason string, type string, is_resolved boolean, {_WHEN}", ("id", "post_id"), {"flag_id": "id", "post_id": "post_id", "user_id": "creator_id", "reason": "reason", "kind": "type", **_AT}),
    "deletion_events": Entity(f"id bigint, post_id bigint, creator_id bigint, action string, reason string, description string, {_WHEN}", ("id", "post_id"), {"event_id": "id", "post_id": "post_id", "user_id": "creator_id", "kind": "action", "reason": "coalesce(reason, description)", **_AT}),
    "post_versions": Entity(f"id bigint, post_id bigint, version int, updater_id bigint, tags string, added_tags array<string>, removed_tags array<string>, rating string, {_WHEN}", ("id", "post_id"), {"version_id": "id", "post_id": "post_id", "version": "version", "user_id": "updater_id", "tags": "tags", "added_tags": "added_tags", "removed_tags": "removed_tags", **_AT}),
    "approvals": Entity(f"id bigint, post_id bigint, user_id bigint, {_WHEN}", ("id", "post_id"), {"approval_id": "id", "post_id": "post_id", "user_id": "user_id", **_AT}),
    "replacements": Entity(f"id bigint, post_id bigint, creator_id bigint, status string, {_WHEN}", ("id", "post_id"), {"replacement_id": "id", "post_id": "post_id", "user_id": "creator_id", "status": "lower(status)", **_AT}),
    "pools": Entity(f"id bigint, name string, category string, creator_id bigint, description string, is_active boolean, post_ids array<bigint>, {_WHEN}", ("id",), {"collection_id": "id", "name": "name", "category": "lower(category)", "post_ids": "coalesce(post_ids, array())", **_AT}),
    "sets": Entity(f"id bigint, name string, shortname string, creator_id bigint, is_public boolean, post_ids array<bigint>, {_WHEN}", ("id",), {"collection_id": "id", "name": "name", "shortname": "shortname", "post_ids": "coalesce(post_ids, array())", **_AT}),
    "pool_versions": Entity(f"id bigint, pool_id bigint, version int, name string, post_ids array<bigint>, updater_id bigint, {_WHEN}", ("id",), {"version_id": "id", "collection_id": "pool_id", "version": "version", "name": "name", "post_ids": "post_ids", "user_id": "updater_id", **_AT}),
    "users": Entity(f"id bigint, name string, level int, is_banned boolean, {_WHEN}", ("id",), {"user_id": "id", "name": _NAME.format("name"), "level": "level", **_AT}),
    "artists": Entity(f"id bigint, name string, other_names array<string>, urls array<string>, is_active boolean, {_WHEN}", ("id",), {"artist_id": "id", "name": "lower(replace(trim(name), ' ', '_'))", "other_names": "other_names", "urls": "urls", **_AT}),
    "artist_urls": Entity(f"id bigint, artist_id bigint, url string, normalized_url string, {_WHEN}", ("id", "artist_id"), {"url_id": "id", "artist_id": "artist_id", "url": "coalesce(normalized_url, url)", **_AT}),
    "artist_versions": Entity(f"id bigint, artist_id bigint, updater_id bigint, name string, urls array<string>, {_WHEN}", ("id", "artist_id"), {"version_id": "id", "artist_id": "artist_id", "user_id": "updater_id", "name": "name", "urls": "urls", **_AT}),
}


def parse(lines: DataFrame, name: str) -> DataFrame:
    """Canonical rows of an entity from JSON lines (value)."""
    spec = ENTITIES[name]
    rows = lines.select(F.from_json("value", spec.fields, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    for k in spec.key:
        rows = rows.where(F.col(k).isNotNull())
    return rows.selectExpr(*(f"{sql} AS `{column}`" for column, sql in spec.columns.items()))


def keys(name: str) -> list[str]:
    """The canonical columns of an entity's key."""
    spec = ENTITIES[name]
    return [column for column, sql in spec.columns.items() if sql in spec.key]


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return parse(spark.read.text(path), name)


def merge(existing: DataFrame, incoming: DataFrame, name: str, posts: DataFrame | None = None) -> DataFrame:
    """The last row of each key wins; with posts given, rows of other posts are left out."""
    if posts is not None and "post_id" in incoming.columns:
        incoming = incoming.join(posts.select("post_id"), "post_id", "left_semi")
    return upsert(existing, incoming.withColumn("_seq", F.coalesce(F.unix_micros("updated_at"), F.lit(0))), keys(name), "_seq")


def members(collections: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """post_id, collection_id, sequence, name (and shortname) of collections; posts that are not there are left out."""
    names = [c for c in ("name", "shortname") if c in collections.columns]
    rows = collections.select("collection_id", *names, F.posexplode("post_ids").alias("sequence", "post_id"))
    return rows if posts is None else rows.join(posts.select("post_id"), "post_id", "left_semi")


def replace_members(edges: DataFrame, incoming: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Edges with all members of the incoming collections in place of those they had; a collection without members has none."""
    new = members(incoming, posts)
    return edges.join(incoming.select("collection_id").distinct(), "collection_id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_collections(collections: DataFrame, edges: DataFrame, incoming: DataFrame, name: str, posts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch of collections: the last row of each wins, and its members replace all."""
    last = latest(incoming.withColumn("_seq", F.coalesce(F.unix_micros("updated_at"), F.lit(0))), keys(name), "_seq").drop("_seq")
    return merge(collections, last, name), replace_members(edges, last, posts)


def hashed_urls(posts: DataFrame) -> DataFrame:
    """url_hash, url of all sources, each hash once."""
    rows = posts.select(F.explode("sources").alias("url"))
    return rows.groupBy(F.sha2(F.col("url").cast("binary"), 256).alias("url_hash")).agg(F.min("url").alias("url"))


def resolve_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows with user_id looked up by user_name where it is missing."""
    names = users.select(F.col("user_id").alias("_id"), F.col("name").alias("_name"))
    joined = rows.join(names, (rows["user_id"].isNull()) & (rows["user_name"] == names["_name"]), "left")
    return joined.withColumn("user_id", F.coalesce("user_id", "_id")).drop("_id", "_name")


def pending_replacements(posts: DataFrame, replacements: DataFrame) -> DataFrame:
    """posts with pending_replacements where the payload did not say."""
    open_ = replacements.where("status = 'pending'").select("post_id").distinct().withColumn("_open", F.lit(True))
    known = [F.col("pending_replacements")] if "pending_replacements" in posts.columns else []
    return posts.join(open_, "post_id", "left").withColumn("pending_replacements", F.coalesce(*known, F.col("_open"), F.lit(False))).drop("_open")


def normal_names(collections: DataFrame) -> DataFrame:
    return collections.withColumn("normalized_name", S.normal_tag(F.col("name")))
