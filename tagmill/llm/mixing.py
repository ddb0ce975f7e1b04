"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
Words flow from patterns to the sources' quotas; pass k over a pattern costs (k - 1)^2
a word, so repeats are spread before anything is repeated more often, and no pattern is
passed more than max_passes times. A pattern that gets t words of its s is taken
t // s times as a whole; for the rest of t % s words documents are selected in the
order of a seeded hash, the last ones so that their words add up.

The selection needs no global order: histograms over hash digits find the digit where
the words run out, digit by digit, until no more than LEAF distinct documents of a
pattern are left; a task each fits those. Patterns (a run with more than max_patterns
raises, none is dropped) and histograms of 2^DIGIT rows a pattern reach the driver.

Null membership is a source of its own. Null and empty texts have size 0 and are taken
as often as their place in the order says, which takes no words. Rows of one document
id are selected together. An empty table gives no rows; further columns pass through,
but for one named copies, which the result replaces.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import MAX_BROADCAST_ROWS, WORD, saved, table

MAX_PASSES = 3
SEED = 20240607
MAX_PATTERNS = 1 << 17
LEAF = 2000
DIGIT, DIGITS = 10, 6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, max_passes: int = MAX_PASSES) -> dict:
    """total shared by weight; a source stops at max_passes times its size, the excess is shared again."""
    out, left = {}, total
    while open_ := [s for s in sizes if s not in out]:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > max_passes * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(max_passes * sizes[s])
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(patterns: dict, quotas: dict, max_passes: int = MAX_PASSES) -> dict:
    """Words of each (pattern, source): patterns is {key: (members, size)}, quotas {source: words}.

    Pass arcs (capacity size, cost (k - 1)^2), membership arcs (free) and quota arcs;
    primal-dual: as there are few different costs, few rounds of distances are needed, and
    each sends all that goes along arcs of no reduced cost in blocking flows.
    """
    ids: dict = {}
    node = lambda x: ids.setdefault(x, len(ids))
    graph: list[list[int]] = []
    to, cap, cost = [], [], []

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            while len(graph) <= max(x, y):
                graph.append([])
            graph[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    start, end = node("start"), node("end")
    graph += [[], []]
    for s, words in quotas.items():
        arc(node(("s", s)), end, words, 0)
    member = {}
    for key, (members, size) in patterns.items():
        for k in range(max_passes):
            arc(start, node(("p", key)), size, k * k)
        for s in members:
            if s in quotas:
                member[key, s] = len(to)
                arc(node(("p", key)), node(("s", s)), max_passes * size, 0)
    height = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if cap[e] and (n := d + cost[e] + height[a] - height[to[e]]) < far[to[e]]:
                    far[to[e]] = n
                    heapq.heappush(heap, (n, to[e]))
        if far[end] == float("inf"):
            break
        height = [h + min(f, far[end]) for h, f in zip(height, far, strict=True)]
        free = lambda a, e: cap[e] and cost[e] + height[a] == height[to[e]]  # noqa: E731, B023
        while True:
            depth, queue = {start: 0}, [start]
            for a in queue:
                for e in graph[a]:
                    if to[e] not in depth and free(a, e):
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if end not in depth:
                break
            turn, path, at = [0] * len(graph), [], start
            while True:
                if at == end:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, at = [], start
                    continue
                while turn[at] < len(graph[at]):
                    e = graph[at][turn[at]]
                    if depth.get(to[e], -1) == depth[at] + 1 and free(at, e):
                        break
                    turn[at] += 1
                if turn[at] < len(graph[at]):
                    path.append(graph[at][turn[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
    return {k: cap[e ^ 1] for k, e in member.items() if cap[e ^ 1]}


def fitted(sizes: np.ndarray, left: int) -> np.ndarray:
    """Which documents, in their seeded order, to take so that their sizes come near left.

    They are taken one after the other while they fit, then whichever later ones still fit;
    then, as long as the sum comes nearer, one is added, dropped or exchanged.
    """
    taken = np.cumsum(sizes) <= left
    left -= int(sizes[taken].sum())
    for k in np.flatnonzero(~taken & (sizes > 0)):
        if sizes[k] <= left:
            taken[k] = True
            left -= int(sizes[k])
    while left:
        gone, new = (np.append(0, np.unique(sizes[x & (sizes > 0)])) for x in (taken, ~taken))
        at = np.searchsorted(new, gone + left)
        pairs = [(abs(left + int(a) - int(b)), int(a), int(b)) for k in (0, 1) for a, b in zip(gone, new[np.clip(at - k, 0, len(new) - 1)], strict=True)]
        least, a, b = min(pairs)
        if least >= abs(left):
            break
        if a:
            taken[np.flatnonzero(taken & (sizes == a))[-1]] = False
        if b:
            taken[np.flatnonzero(~taken & (sizes == b))[0]] = True
        left += a - b
    return taken


def _fit(rows: pa.Table) -> pa.Table:
    """Of a pattern's rows (pattern, _id, _h, w, _rest), those taken."""
    ids = rows.column("_id").to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda k: (rows.column("_h")[k].as_py(), str(ids[k]))), np.int64)
    sizes = rows.column("w").to_numpy().astype(np.int64)[order]
    kept = order[fitted(sizes, rows.column("_rest")[0].as_py())]
    return rows.select(["pattern", "_id"]).take(pa.array(kept)).rename_columns(["_p", "_doc"])


def mix(df: DataFrame, id_col: str, size: Column, members: Column, weights, max_passes: int = MAX_PASSES, seed: int = SEED, share: float = 1.0, max_patterns: int = MAX_PATTERNS):
    """(df with copies, {source: size}, {source: target}).

    weights: from the list of sources (code point order, null last) to {source: weight}.
    """
    spark, names = df.sparkSession, df.columns
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 64 - DIGIT * DIGITS)
    marked = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(id_col).alias("_id"), size.alias("size"), pattern.alias("pattern"), key.alias("_h"))
    light = saved(spark, marked.select("_id", "size", "pattern", "_h"), "patterns")
    found = light.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    # a null pattern is a null array: no source at all, so never taken
    groups = {r.pattern: (json.loads(r.pattern), r["size"]) for r in found if r.pattern is not None}
    sizes: dict = {}
    for sources, words in groups.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    ordered = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    total = sum(r["size"] for r in found) * share
    goal = targets({s: sizes[s] for s in ordered}, weights(ordered), total, max_passes)
    flow = min_cost_flow(groups, {s: round(w) for s, w in goal.items()}, max_passes)
    taken: dict = {}
    for (p, _), words in flow.items():
        taken[p] = taken.get(p, 0) + words

    whole, cut = {}, {}
    counts = {r.pattern: r.n for r in found}
    open_, leaves = {}, []
    for p, (_, words) in groups.items():
        t = taken.get(p, 0)
        whole[p], rest = divmod(t, words) if words else (0, 0)
        cut[p] = 0
        if rest and counts[p] > LEAF:
            open_[p] = (0, rest)
        elif rest:
            leaves.append((p, 0, 1 << DIGIT * DIGITS, rest))
    for digit in range(DIGITS):
        if not open_:
            break
        shift = DIGIT * (DIGITS - 1 - digit)
        now = spark.createDataFrame([(k, lo) for k, (lo, _) in open_.items()], "pattern string, _lo long")
        inside = light.join(F.broadcast(now), "pattern").where(f"shiftright(_h, {shift + DIGIT}) = shiftright(_lo, {shift + DIGIT})")
        sums: dict = {}
        for r in inside.groupBy("pattern", F.expr(f"shiftright(_h, {shift})").alias("b")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).toLocalIterator():
            sums.setdefault(r.pattern, []).append((r.b, r.w, r.n))
        still = {}
        for p, buckets in sums.items():
            rest = open_[p][1]
            for b, words, n in sorted(buckets):
                if words > rest:
                    cut[p] = b << shift
                    if n <= LEAF or digit == DIGITS - 1:
                        leaves.append((p, b << shift, (b + 1) << shift, rest))
                    else:
                        still[p] = (b << shift, rest)
                    break
                rest -= words
            else:
                cut[p] = 1 << DIGIT * DIGITS
        open_ = still
    now = spark.createDataFrame(leaves, "pattern string, _lo long, _hi long, _rest long")
    ends = light.join(F.broadcast(now), "pattern").where("_h >= _lo and _h < _hi").groupBy("pattern", "_id", "_h", "_rest").agg(F.sum("size").alias("w"))
    id_type = light.schema["_id"].dataType.simpleString()
    chosen = saved(spark, ends.groupBy("pattern").applyInArrow(_fit, f"_p string, _doc {id_type}"), "chosen").withColumn("_in", F.lit(1))
    if chosen.count() <= MAX_BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    plan = spark.createDataFrame([(p, int(whole[p]), int(cut[p])) for p in groups], "pattern string, _whole long, _cut long")
    out = marked.join(F.broadcast(plan), "pattern", "left")  # max_patterns rows
    out = out.join(chosen, F.col("pattern").eqNullSafe(F.col("_p")) & F.col("_id").eqNullSafe(F.col("_doc")), "left")
    extra = F.when((F.col("_h") < F.col("_cut")) | F.col("_in").isNotNull(), 1).otherwise(0)
    copies = F.coalesce(F.col("_whole") + extra, F.lit(0)).cast("long").alias("copies")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c != "copies"), copies), sizes, goal


def repeating(pattern=(5, 2, 1)):
    return lambda ordered: {s: pattern[k % len(pattern)] for k, s in enumerate(ordered)}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = saved(spark, table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    mixed, sizes, goal = mix(docs, "doc_id", F.col("size"), F.array("source"), repeating())
    per = spark.createDataFrame([(s, int(sizes[s]), float(goal[s])) for s in sizes], "_s string, source_size long, target double")
    out = mixed.join(F.broadcast(per), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # no column of the input can clash with the mix's own
    at = dict(zip(names, inner, strict=True))
    mixed, _, _ = mix(docs.toDF(*inner), at["doc_id"], n_words(F.col(at["text"])), F.array(at["source"]), repeating())
    taken = mixed.where("copies > 0").select(*inner, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.drop("_copy").toDF(*names)
