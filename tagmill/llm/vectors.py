"""Vectors that take part in a search, with equal ones brought together.

Of equal vectors a search needs no more than the k + 1 smallest ids: whatever query they
answer, they score alike and rank by id. So each distinct vector is one candidate that
carries those ids, and equal queries are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import hot_join

#: Candidates of a block and queries of a chunk, as compared at once.
BLOCK, CHUNK = 2048, 8192


def matrix(column) -> np.ndarray:
    """Rows of doubles from a column of their bytes."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def usable(df: DataFrame, floors: bool, zero: bool) -> DataFrame:
    """vec_id, dim, vec (the doubles' bytes) of rows without nulls or non-finite components.

    floors: vec holds floor(256 * x). zero: vectors of zeros take part.
    """

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("embedding")
            values = lists.flatten()
            null = np.asarray(values.is_null())
            x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
            size = np.asarray(pa.compute.list_value_length(lists).fill_null(0)).astype(np.int64)
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(null | ~np.isfinite(x))))
            some = np.concatenate(([0], np.cumsum(x != 0)))
            ok = (size > 0) & (bad[ends] == bad[ends - size]) & np.asarray(ids.is_valid())
            if not zero:
                ok &= some[ends] > some[ends - size]
            if floors:
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.clip(np.floor(256 * x), -1.7e308, 1.7e308)
            x = x + 0.0  # -0 becomes 0, so that equal vectors have equal bytes
            at = np.flatnonzero(ok)
            vec = [x[b - n : b].tobytes() for b, n in zip(ends[at].tolist(), size[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(size[at].astype(np.int32)), pa.array(vec, pa.binary())], ["vec_id", "dim", "vec"])

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary")


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """vid (the smallest id), dim, vec, ids (the k + 1 smallest) for each distinct vector."""
    order = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("_k", order).where(F.col("_k") <= k + 1)
    return few.groupBy("vec").agg(F.min("vec_id").alias("vid"), F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def asked(rows: DataFrame, candidates: DataFrame, every: int) -> DataFrame:
    """query_id and the vid of its vector, for ids divisible by every."""
    own = rows.where(F.col("vec_id") % every == 0).distinct()
    return hot_join(own, candidates.select("vec", "vid"), ["vec"]).select(F.col("vec_id").alias("query_id"), "vid")


def ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from (qid, ids, score) per query vector and candidate."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1).select(F.col("qid").alias("vid"), "score", F.explode("ids").alias("vec_id"))
    rows = hot_join(queries, found, ["vid"]).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
