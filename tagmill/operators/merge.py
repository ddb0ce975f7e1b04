"""Keyed merges, edge replacement and set operations, without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.col(sequence).desc_nulls_last())
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """existing with incoming's last row of each key in place of its own."""
    new = latest(incoming, keys, sequence).drop(sequence)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_edges(existing: DataFrame, incoming: DataFrame, owner: str, touched: DataFrame | None = None) -> DataFrame:
    """All edges of the owners that incoming (or touched) names give way to incoming's."""
    owners = (touched if touched is not None else incoming).select(owner).distinct()
    return existing.join(owners, owner, "left_anti").unionByName(incoming.distinct())


def existing_only(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """Edges to posts that are there."""
    return edges.join(posts.select("post_id"), "post_id", "left_semi")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(existing.select(*keys), keys, "left_anti")


def import_report(incoming: DataFrame, existing: DataFrame, valid: str, keys: list[str]) -> DataFrame:
    """seen, accepted, rejected, inserted, matched of one import."""
    here = existing.select(*keys).distinct().withColumn("_here", F.lit(True))
    rows = incoming.join(here, keys, "left")
    ok = F.coalesce(F.col(valid), F.lit(False))
    return rows.agg(
        F.count("*").alias("seen"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(ok & F.col("_here").isNull()).alias("inserted"),
        F.count_if(ok & F.col("_here").isNotNull()).alias("matched"),
    )


def conflicting_hashes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("kinds"), F.min(value).alias("first")).where("kinds > 1")


def collisions(staged: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Staged keys that are stored with another value: key, value, stored."""
    known = stored.select(F.col(key), F.col(value).alias("stored"))
    return staged.select(key, value).distinct().join(known, key).where(F.col("stored") != F.col(value))


def merge_candidates(first: DataFrame, second: DataFrame, key: str = "post_id") -> DataFrame:
    """Ids of both lists, each once, the first list's before the second's (columns: id, position)."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    own = Window.partitionBy(key).orderBy("_list", "position")
    return both.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def child_counts(posts: DataFrame) -> DataFrame:
    """posts with child_count recomputed from their parents' ids."""
    counts = posts.where("parent_post_id is not null").groupBy(F.col("parent_post_id").alias("post_id")).agg(F.count("*").alias("child_count"))
    return posts.drop("child_count").join(counts, "post_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def embedded(rows: DataFrame, key: str, ids: str, other: DataFrame, other_key: str) -> DataFrame:
    """rows' id arrays joined to other, in the arrays' order (key, position, other's columns)."""
    flat = rows.select(F.col(key).alias("_owner"), F.posexplode(ids).alias("position", "_id"))
    return flat.join(other, flat["_id"] == other[other_key]).drop("_id").withColumnRenamed("_owner", f"owner_{key}")
