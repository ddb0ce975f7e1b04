"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square test.

Unit vectors are projected by M Gaussian (2-stable) directions, so the squared projected
distance of two vectors over their squared distance follows a chi-square law with M
degrees of freedom. The projections are indexed by a kd-tree: its upper levels cut them
into cells (split at medians of a sample of SAMPLE rows, those of the smallest hashes;
every row is indexed), its lower levels cut each cell's block into leaves. A query takes
leaves by increasing projected distance, verifies their vectors by true cosines, and
stops as soon as a vector as near as its current (k + 1)-th best would with probability
SURE have shown a smaller projected distance than the next leaf's. Round 1 searches the
query's own cell; round 2 all other blocks that the same test on their boxes leaves,
starting from round 1's distance.

Vectors null, empty, zero, or with null or non-finite components take no part, nor do
rows without an id; vectors of different length are not compared. Rows that repeat id
and vector are one. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.llm.common import MAX_BROADCAST_ROWS, saved, table
from tagmill.llm.vectors import CHUNK, asked, distinct, matrix, ranked, usable

M, SURE, SAMPLE, LEAF = 8, 0.98, 16384, 64
K, EVERY = 5, 50
#: Rows of a cell; beyond MAX_CELLS cells, which bounds what the tree's broadcast holds, cells grow.
CELL, MAX_CELLS = 4096, 1 << 14
#: A cell of more rows than this is salted into several blocks; distances of queries to boxes in memory at once.
MAX_BLOCK, ROUTED = 16384, 1 << 20
_SPARE = 4


def chi_square(x: np.ndarray) -> np.ndarray:
    """The distribution function with M (even) degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-h) * sum(h**j / math.factorial(j) for j in range(M // 2))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(20011 + dim).standard_normal((dim, M))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def project(u: np.ndarray) -> np.ndarray:
    return u @ directions(u.shape[1])


def split_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each inner node of a complete kd-tree, heap order, split at medians of the widest axis."""
    axis, value = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    sets = {0: points}
    for node in range(len(axis)):
        own = sets.pop(node)
        if len(own):
            axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            value[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > value[node]
        sets[2 * node + 1], sets[2 * node + 2] = own[~right], own[right]
    return axis, value


def descend(points: np.ndarray, tree) -> np.ndarray:
    """The leaf of each point."""
    axis, value = tree
    node = np.zeros(len(points), np.int64)
    while len(axis) and node[0] < len(axis):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(axis)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over the points."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = points[rows]
        ax = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, ax], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k : k + 1]
        d = np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0)
        out += d * d
    return out


def enough(gap: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The stopping test: squared projected distance of what comes next, squared distance of the worst kept."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ratio = np.where(far > 1e-12, gap / far, np.where(gap > 1e-9, np.inf, 0.0))
    return chi_square(np.where(np.isfinite(far), ratio, 0.0)) >= SURE


def search(q: np.ndarray, far: np.ndarray, r: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (-1: none) and cosines of the best found for unit rows q among r; far: squared distances known before."""
    pq, pr = project(q), project(r)
    parts = leaves(pr)
    low, high = (np.array([f(pr[p], axis=0) for p in parts]) for f in (np.min, np.max))
    gap = gaps(pq, low, high)
    order = np.argsort(gap, axis=1)
    best, at = np.full((len(q), keep + _SPARE), -np.inf), np.full((len(q), keep + _SPARE), -1)
    far, live = far.copy(), np.arange(len(q))
    for step in range(len(parts)):
        nxt = order[live, step]
        going = ~enough(gap[live, nxt], far[live])
        live, nxt = live[going], nxt[going]
        if not len(live):
            break
        turn = np.argsort(nxt, kind="stable")
        cuts = np.flatnonzero(np.diff(nxt[turn], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(turn)], strict=True):
            rows, own = live[turn[a:b]], parts[nxt[turn[a]]]
            found = np.concatenate((best[rows], q[rows] @ r[own].T), axis=1)
            names = np.concatenate((at[rows], np.broadcast_to(own, (len(rows), len(own)))), axis=1)
            top = np.argpartition(-found, keep + _SPARE - 1, axis=1)[:, : keep + _SPARE]
            # where equal cosines reach beyond the cut, the smaller rows stay: ids ascend with them
            least = np.take_along_axis(found, top, axis=1).min(axis=1)
            for k in np.flatnonzero(((found >= least[:, None]).sum(axis=1) > keep + _SPARE) & np.isfinite(least)):
                top[k] = np.lexsort((names[k], -found[k]))[: keep + _SPARE]
            best[rows], at[rows] = np.take_along_axis(found, top, axis=1), np.take_along_axis(names, top, axis=1)
        worst = -np.sort(-best[live], axis=1)[:, keep - 1]
        far[live] = np.minimum(far[live], np.maximum(0, 2 - 2 * worst))
    return at, best


def _search(keep: int):
    def run(queries, block):
        import pandas as pd

        out = []
        if len(queries) and len(block):
            block = block.sort_values("vid")
            v, x = matrix(block["vec"]), matrix(queries["vec"])
            u, ids = unit(v), block["ids"].to_numpy()
            far = queries["far"].to_numpy(float)
            for i in range(0, len(x), 512):
                at, _ = search(unit(x[i : i + 512]), far[i : i + 512], u, keep)
                row, col = np.nonzero(at >= 0)
                at = at[row, col]
                # the exact measure, summed alike wherever a vector lies
                a, b = x[i : i + 512][row], v[at]
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                score = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                order = np.lexsort((at, -score, row))
                row, at, score = row[order], at[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < keep
                out.append(pd.DataFrame({"qid": queries["vid"].to_numpy()[i : i + 512][row[kept]], "ids": ids[at[kept]], "score": score[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "ids": [], "score": []}, dtype=object)

    return run


def _projected(df: DataFrame) -> DataFrame:
    def run(frames):
        for f in frames:
            p = np.zeros((len(f), M))
            for d in f["dim"].unique():
                own = (f["dim"] == d).to_numpy()
                p[own] = project(unit(matrix(f.loc[own, "vec"])))
            if len(f):
                yield f.assign(p=list(p))

    return df.mapInPandas(run, T.StructType([*df.schema, T.StructField("p", T.ArrayType(T.DoubleType()))]))


def nearest(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines found, ties to smaller ids."""
    spark = df.sparkSession
    rows = saved(spark, usable(df, False, False), "vectors")
    candidates = saved(spark, _projected(distinct(rows, k)), "candidates")
    queries = saved(spark, asked(rows, candidates, every), "queries")
    n = candidates.count()
    levels = max(0, min(MAX_CELLS, -(-n // CELL)) - 1).bit_length()
    sample = candidates.select("p", F.xxhash64("vid").alias("h"), "vid").orderBy("h", "vid").limit(SAMPLE).select("p").toPandas()
    tree = split_tree(np.array(sample["p"].tolist(), float).reshape(-1, M), levels)
    plan = spark.sparkContext.broadcast(tree)

    def into_cells(frames):
        for f in frames:
            if len(f):
                yield f.assign(cell=descend(np.array(f["p"].tolist(), float), plan.value).astype(np.int32))

    placed = saved(spark, candidates.mapInPandas(into_cells, T.StructType([*candidates.schema, T.StructField("cell", T.IntegerType())])), "cells")
    box = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("p")[j]) for j in range(M))).alias("low"), F.array(*(F.max(F.col("p")[j]) for j in range(M))).alias("high"))
    # at most MAX_CELLS cells for each length of vectors, whatever the number of rows
    boxes = box.limit(MAX_BROADCAST_ROWS + 1).toPandas().sort_values(["dim", "cell"])
    if len(boxes) > MAX_BROADCAST_ROWS:
        raise ValueError("vectors of too many different lengths")
    known = spark.sparkContext.broadcast({int(d): (g["cell"].to_numpy(), np.array(g["low"].tolist()), np.array(g["high"].tolist())) for d, g in boxes.groupby("dim")})
    salts = spark.createDataFrame([(int(d), int(c), -(-int(n) // MAX_BLOCK)) for d, c, n in zip(boxes["dim"], boxes["cell"], boxes["n"], strict=True)], "dim int, cell int, salts int")
    ask = placed.join(queries.select("vid").distinct(), "vid", "left_semi").select("vid", "dim", "vec", "p", F.col("cell").alias("home"))

    def routes(home: bool):
        def run(frames):
            import pandas as pd

            for f in frames:
                for d, own in f.groupby("dim"):
                    cell, low, high = known.value[int(d)]
                    step = max(1, ROUTED // len(cell))
                    for k in range(0, len(own), step):
                        some = own.iloc[k : k + step]
                        go = some["home"].to_numpy()[:, None] == cell[None, :]
                        far = some["far"].to_numpy(float)
                        if not home:
                            go = ~go & ~enough(gaps(np.array(some["p"].tolist(), float), low, high), far[:, None])
                        i, j = np.nonzero(go)
                        yield pd.DataFrame({"vid": some["vid"].to_numpy()[i], "dim": int(d), "vec": some["vec"].to_numpy()[i], "far": far[i], "cell": cell[j]})

        return run

    key = ["dim", "cell", "salt", "chunk"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")

    def round_(asking: DataFrame, home: bool) -> DataFrame:
        """Each cell's queries, in chunks, meet its blocks; cells that no query is routed to are not read."""
        routed = saved(spark, asking.mapInPandas(routes(home), "vid long, dim int, vec binary, far double, cell int"), "routed")
        each = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).join(F.broadcast(salts), ["dim", "cell"])
        each = F.broadcast(each)  # a row a cell
        asked_ = routed.join(each, ["dim", "cell"]).withColumn("chunk", part("chunks")).withColumn("salt", numbers("salts"))
        blocks = placed.select("vid", "dim", "vec", "ids", "cell").join(each, ["dim", "cell"]).withColumn("salt", part("salts")).withColumn("chunk", numbers("chunks"))
        sides = asked_.select("vid", "vec", "far", *key), blocks.select("vid", "vec", "ids", *key)
        return sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInPandas(_search(k + 1), "qid long, ids array<long>, score double")

    first = saved(spark, round_(ask.withColumn("far", F.lit(float("inf"))), True), "round1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    kth = first.withColumn("_k", place).where(F.col("_k") == k + 1).select(F.col("qid").alias("vid"), (2 - 2 * F.col("score")).alias("far"))
    again = ask.join(kth, "vid", "left").withColumn("far", F.greatest(F.coalesce("far", F.lit(float("inf"))), F.lit(0.0)))
    return ranked(first.unionByName(round_(again, False)), queries, k)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
