"""Exact top-k search by a three-phase uniform threshold.

A vector's components are dealt to PARTS parts; each part scores every candidate on its
own components, and a candidate's score is the sum over the parts. Phase 1: each part's
best local scores, every other score replaced by the part's least, give lower bounds of
sums; the k-th best bound, less the parts' least scores, divided by the number of parts,
is a cutoff that no part can miss a result with. Phase 2: each part collects all entries
from the cutoff on; sums of these raise the k-th best lower bound. Phase 3: candidates
whose upper bound (cutoffs for what was not collected) reaches it are scored exactly.

Candidates lie in blocks, queries in chunks; a task compares one block with one chunk.
Scores are integer inner products of floor(256 * x): exact in double precision while
they stay below 2^53, in Python integers beyond, and held to the range of a long.

Vectors null, empty, or with null or non-finite components take no part, nor do rows
without an id; vectors of different length are not compared. Rows that repeat id and
vector are one. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import saved, table
from tagmill.llm.vectors import BLOCK, CHUNK, asked, distinct, matrix, ranked, usable

PARTS = 4
K, EVERY = 5, 50
#: Queries whose scores with a block are in memory at once.
_AT_ONCE = 256


def _dots(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond doubles' exact range Python integers, for the rows that reach there."""
    if not q.shape[1]:
        return np.zeros((len(q), len(r)))
    most = [np.abs(x).max(axis=1, initial=0) for x in (q, r)]
    small = [most[0] * most[1].max(initial=0) * q.shape[1] < 2**53, most[1] * most[0].max(initial=0) * q.shape[1] < 2**53]
    if small[0].all() or small[1].all():
        return q @ r.T
    # two rows that stay small with themselves do so with each other
    limit = (2**53 / q.shape[1]) ** 0.5
    small = [x < limit for x in most]
    whole = [np.frompyfunc(int, 1, 1)(x) for x in (q, r)]
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.empty((len(q), len(r)), dtype=object)
        a, b = (np.flatnonzero(x) for x in small)
        out[np.ix_(a, b)] = np.frompyfunc(int, 1, 1)(q[a] @ r[b].T) if len(a) and len(b) else 0
    for rows, cols in ((np.flatnonzero(~small[0]), np.arange(len(r))), (a, np.flatnonzero(~small[1]))):
        if len(rows) and len(cols):
            out[np.ix_(rows, cols)] = whole[0][rows] @ whole[1][cols].T
    return out


def parts_of(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    cuts = np.linspace(0, q.shape[1], PARTS + 1).astype(int)
    return [_dots(q[:, a:b], r[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, or as many as there are."""
    x = np.sort(x, axis=1)[:, ::-1][:, :k] if x.dtype == object or x.shape[1] <= k else -np.sort(np.partition(-x, k - 1, axis=1)[:, :k], axis=1)
    return x.astype(float)


def _phase(number: int, k: int):
    def run(queries, block):
        import pandas as pd

        empty = {1: ["qid", "bounds", "least"], 2: ["qid", "bounds"], 3: ["qid", "ids", "score"]}[number]
        out = []
        if len(queries) and len(block):
            block = block.sort_values("vid")
            r = matrix(block["vec"])
            ids = block["ids"].to_numpy()
            for i in range(0, len(queries), _AT_ONCE):
                part = queries.iloc[i : i + _AT_ONCE]
                scores = parts_of(matrix(part["vec"]), r)
                if number == 1:
                    bound, least = 0, []
                    for s in scores:
                        low = s.min(axis=1)
                        kth = np.sort(s, axis=1)[:, -min(k, s.shape[1])]
                        bound = bound + np.where(s >= kth[:, None], s, low[:, None])
                        least.append(low.astype(float))
                    out.append(pd.DataFrame({"qid": part["vid"].to_numpy(), "bounds": list(_best(bound, k)), "least": list(np.stack(least, axis=1))}))
                    continue
                low = np.stack(part["least"].to_numpy())
                floor = low.sum(axis=1)
                # a cutoff a little too low collects more, never less
                step = (part["first"].to_numpy(float) - floor) / PARTS
                step -= np.abs(step) * 1e-9 + 1e-9 * np.abs(floor)
                bound, missing = floor[:, None] + np.zeros(scores[0].shape), np.zeros(scores[0].shape)
                for j, s in enumerate(scores):
                    here = s >= (low[:, j] + step)[:, None]
                    bound = bound + np.where(here, s - low[:, j : j + 1], 0)
                    missing += ~here
                if number == 2:
                    out.append(pd.DataFrame({"qid": part["vid"].to_numpy(), "bounds": list(_best(bound, k))}))
                    continue
                reach = bound + missing * np.maximum(step, 0)[:, None]
                least = part["second"].to_numpy(float)
                rest = reach >= (least - np.abs(least) * 1e-9 - 1e-6)[:, None]
                at, col = np.nonzero(rest)
                total = sum(s[at, col] for s in scores)
                if total.dtype == object:
                    total = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in total], np.int64)
                total = total.astype(np.int64)
                order = np.lexsort((col, -total.astype(object) if len(total) and total.min() == -(2**63) else -total, at))
                at, col, total = at[order], col[order], total[order]
                first = np.searchsorted(at, at)
                keep = np.arange(len(at)) - first < k
                out.append(pd.DataFrame({"qid": part["vid"].to_numpy()[at[keep]], "ids": ids[col[keep]], "score": total[keep]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in empty}, dtype=object)

    return run


def _kth(bounds: DataFrame, name: str, k: int) -> DataFrame:
    """The k-th largest bound of each query (the least, if there are fewer)."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("b")))
    top = bounds.select("qid", F.explode("bounds").alias("b")).withColumn("_k", place).where(F.col("_k") <= k)
    return top.groupBy("qid").agg(F.min("b").alias(name))


def top_k(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products, ties to smaller ids."""
    spark = df.sparkSession
    rows = saved(spark, usable(df, True, True), "vectors")
    candidates = saved(spark, distinct(rows, k), "candidates")
    queries = saved(spark, asked(rows, candidates, every), "queries")
    n, m = candidates.count(), queries.select("vid").distinct().count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-m // CHUNK))
    put = lambda x, parts: F.pmod(F.xxhash64("vid"), F.lit(parts)).cast("int").alias(x)
    ask = candidates.join(queries.select("vid").distinct(), "vid", "left_semi").select("vid", "dim", "vec", put("chunk", chunks))
    ask = saved(spark, ask, "asked")
    held = candidates.select("vid", "dim", "vec", "ids", put("block", blocks), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def phase(number: int, asking: DataFrame, schema: str) -> DataFrame:
        spread = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["dim", "chunk", "block"]
        return spread.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_phase(number, k + 1), schema)

    first = saved(spark, phase(1, ask, "qid long, bounds array<double>, least array<double>"), "phase1")
    least = first.groupBy("qid").agg(F.array(*(F.min(F.col("least")[j]) for j in range(PARTS))).alias("least"))
    cut = least.join(_kth(first, "first", k + 1), "qid").withColumnRenamed("qid", "vid")
    ask = saved(spark, ask.join(cut, "vid"), "cutoffs")
    second = _kth(phase(2, ask, "qid long, bounds array<double>"), "second", k + 1).withColumnRenamed("qid", "vid")
    ask = saved(spark, ask.join(second, "vid"), "raised")
    found = phase(3, ask, "qid long, ids array<long>, score long")
    return ranked(found, queries, k)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_sql() -> str:
    return f"""
WITH flat AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM flat WHERE x IS NULL OR NOT isfinite(x)),
ok AS (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS v FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
vecs AS (SELECT vec_id, list(v ORDER BY i) AS v FROM ok GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= {K}"""
