"""The corpus pipeline: each stage applies one operator to all that the stage before kept.

1. language ID: documents without a learned language go, and those whose best language holds
   less than LEAST_SCORE (0.3) of their n-grams;
2. MinHash near-dedup: one document of each group of near copies stays;
3. mixing sources to target weights: documents the mix leaves out go, repeated ones repeat;
4. byte-level BPE: the ids' count and digest, and the digest of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import bpe, dedup, langid, mixing
from tagmill.llm.common import saved

STAGES = [
    ("language_id", langid.stage_langid),
    ("near_dedup", dedup.stage_dedup),
    ("mixing", mixing.stage_mix),
    ("byte_bpe", bpe.stage_bpe),
]
#: Hash-seeded selection and BPE merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of sf_dir, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
