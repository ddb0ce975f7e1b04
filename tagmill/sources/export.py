"""Sinks: JSON documents, manifests, stored posts."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import scalars as S

SCHEMA_VERSION = 1


def documents(posts: DataFrame) -> DataFrame:
    """path (zero-padded id) and the compact JSON of each post, keys in code point order."""
    ordered = F.struct(*(F.col(f"`{c}`") for c in sorted(posts.columns)))
    return posts.select(S.file_path(F.col("post_id"), F.lit("post"), F.lit("json")).alias("path"), F.to_json(ordered, {"ignoreNullFields": "false"}).alias("json"))


def write_json(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").json(path)


def links(posts: DataFrame, files: DataFrame) -> DataFrame:
    """post_id, path and target of each downloaded file of the posts (files: post_id, variant, ext, local_path)."""
    rows = files.where("local_path is not null").join(posts.select("post_id"), "post_id", "left_semi")
    return rows.select("post_id", S.file_path(F.col("post_id"), F.col("variant"), F.col("ext")).alias("path"), F.col("local_path").alias("target"))


def stale_files(files: DataFrame) -> DataFrame:
    """Files whose checksum is not the digest their post names."""
    return files.where(F.col("checksum").isNotNull() & F.col("md5").isNotNull() & (F.lower("checksum") != F.lower("md5")))


def write_store(tables: DataFrame | dict[str, DataFrame], path: str, generation: int) -> None:
    """A generation of one table (data) or several, then the manifest that makes it the store's.

    Nothing is overwritten: readers keep the generation before until the manifest is there,
    and a crash leaves it.
    """
    tables = tables if isinstance(tables, dict) else {"data": tables}
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}-{generation}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}-{generation}").count()
    manifest = {"schema_version": SCHEMA_VERSION, "generation": generation, "counts": counts, "status": "ready"}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest-{generation}")


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the last ready generation; ValueError if there is none of this version."""
    try:
        found = [json.loads(r.value) for r in spark.read.text(f"{path}/manifest-*").collect()]
    except AnalysisException:
        found = []
    ready = [m for m in found if m["status"] == "ready" and m["schema_version"] == SCHEMA_VERSION]
    if not ready:
        raise ValueError(f"the store at {path} is not readable: {found or 'no manifest'}")
    return max(ready, key=lambda m: m["generation"])


def read_store(spark: SparkSession, path: str, name: str = "data") -> DataFrame:
    """The rows of a table of the store's last generation."""
    return spark.read.parquet(f"{path}/{name}-{manifest(spark, path)['generation']}")
