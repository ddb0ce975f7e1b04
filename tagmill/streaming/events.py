"""Structured Streaming: incremental ingest, standing searches, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.lang.bind import bind
from tagmill.operators.merge import upsert
from tagmill.plans.catalog import Catalog
from tagmill.plans.compile import Compiler
from tagmill.sources.snapshot import accepted, from_payloads


def stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def standing_search(posts: DataFrame, text: str, now=None, tags=None) -> DataFrame:
    """The matching rows of a stream of posts; conditions on sidecars need a batch search."""
    query = bind(text, tags, now).checked()
    compiled = Compiler(Catalog.of(posts)).run(query)
    if compiled.joins or compiled.flags or compiled.tag_flags is not None:
        raise ValueError("a standing search is on the posts' own columns")
    return posts.where(compiled.filter)


def ingest(spark: SparkSession, payloads: DataFrame, checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """A query that merges payload batches (value) into a store: the last payload of an id wins.

    read gives the store's rows, write replaces them (batch id for idempotence: a batch
    that is run again writes the same generation).
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = accepted(from_payloads(batch)).withColumn("_seq", F.coalesce(F.unix_micros("updated_at"), F.lit(0)))
        write(upsert(read(), rows, ["post_id"], "_seq"), number)

    return payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values per window and type; rows later than the watermark are left out of closed windows."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round("value").cast("long")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
