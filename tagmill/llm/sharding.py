"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (offset and
skip from a digest of its name). The shards take turns; at its turn a shard claims the
first free slot of its order. A key's slot is its digest modulo the table's size, so
placement is one lookup, shares differ by at most one slot, and a shard that leaves
moves few keys besides its own.

Null keys count as the empty string. Equal keys share a shard. An empty table gives no
rows; further columns pass through, but for those named key_hash, slot or shard, which
the result's own replace (the key may be one of them).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import table

SHARDS = 64
TABLE_SIZE = 65537
#: The lookup table is broadcast; this bounds it.
MAX_TABLE_SIZE = 1 << 22


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def digest(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not is_prime(size) or size > MAX_TABLE_SIZE:
        raise ValueError("the table's size must be a prime of at most MAX_TABLE_SIZE")
    if not 0 < len(names) <= size or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, one at least, no more than slots")
    offset = [digest(x, "offset") % size for x in names]
    skip = [digest(x, "skip") % (size - 1) + 1 if size > 2 else 1 for x in names]
    owner, at, free = [-1] * size, list(offset), size
    while free:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return np.array(owner, dtype=np.int32)


def key_hash(column):
    """60 bits of the key's MD5, which SQL engines compute alike."""
    hexed = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def assign(df: DataFrame, key: str, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with key_hash, slot and shard; no shuffle, the table is the broadcast side."""
    owner = lookup_table(names, size)
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, int(k)) for i, k in enumerate(owner)], "slot long, shard int")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("key_hash", "slot", "shard")]
    placed = df.select(*kept, key_hash(F.col(f"`{key}`")).alias("key_hash")).withColumn("slot", F.col("key_hash") % F.lit(size))
    return placed.join(F.broadcast(slots), "slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign(docs, "doc_id", shard_names()).select("doc_id", "key_hash", "slot", "shard")


def op4_sql() -> str:
    owner = ",".join(map(str, lookup_table(shard_names())))
    return f"""
WITH hashed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key_hash
  FROM documents),
slots AS (SELECT [{owner}] AS owner)
SELECT doc_id, key_hash, key_hash % {TABLE_SIZE} AS slot,
       CAST(owner[key_hash % {TABLE_SIZE} + 1] AS INTEGER) AS shard
FROM hashed, slots"""
