"""Lineage of iterative operators, and folders for what is written on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine (tests)."""
    sc = spark.sparkContext
    named, own = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if not named and own.isDefined():
        return own.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        named = "file://" + tempfile.gettempdir() + "/tagmill-checkpoints"
    if own.isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nobody has used."""
    return f"{shared_folder(spark)}/tagmill/{name}-{uuid.uuid4().hex}"
