"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few short columns that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only on a single machine (tests)."""
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


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it again: short lineage that outlives executors.

    The files stay until clear(): a lazy result may still read them.
    """
    import uuid

    path = f"{checkpoint_dir(spark)}/tagmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a join may leave in one task; hotter keys, HOT_KEYS at most, are broadcast.
HOT_ROWS, HOT_KEYS = 200, 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined to right by keys that may be hot in left, and have few rows in right.

    Keys of more than a HOT_KEYS-th of left's rows (and of HOT_ROWS), so fewer than
    HOT_KEYS of them, are joined by a broadcast where the rows lie; the others by a shuffle.
    hot: those keys, where they are known.
    """
    if hot is None:
        least = max(HOT_ROWS, left.count() // HOT_KEYS)
        hot = saved(left.sparkSession, left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*keys), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    here = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return here.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


_BATCH, _DEFAULT_BATCH = 8 << 20, ("67108864", "67108864b", "64MB", "64m")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers 8 MB at a time, not 64, unless the session says otherwise:
    a task holds a batch on both sides, and more bytes at once make nothing faster."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, _DEFAULT_BATCH[0]) in _DEFAULT_BATCH:
        spark.conf.set(name, str(_BATCH))


def lowered(column):
    """A-Z lower-cased; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def clear(spark: SparkSession) -> None:
    """Delete what saved() wrote; no result that reads it may be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tagmill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
