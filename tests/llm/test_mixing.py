import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagmill.llm import mixing


def test_targets_stop_at_three_times_and_share_again():
    sizes = {"a": 1, "b": 100, "c": 100, None: 10}
    goal = mixing.targets(sizes, mixing.repeating()(["a", "b", "c", None]), 211)
    assert goal["a"] == 3 and goal[None] == 30 and sum(goal.values()) == pytest.approx(211)
    assert goal["b"] / goal["c"] == pytest.approx(2)
    assert mixing.targets({}, {}, 0) == {}


def cost(flow, patterns, passes):
    total = 0
    for key, (_, size) in patterns.items():
        words = sum(w for (p, _), w in flow.items() if p == key)
        for k in range(passes):
            part = min(size, max(0, words - k * size))
            total += part * k * k
    return total


def test_flow_is_as_large_and_cheap_as_any():
    r = random.Random(4)
    for _ in range(40):
        patterns = {k: (r.sample("abc", r.randint(1, 3)), r.randint(1, 3)) for k in range(r.randint(1, 2))}
        quotas = {s: r.randint(0, 4) for s in "abc"}
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        arcs = [(k, s) for k, (m, _) in patterns.items() for s in m]
        best = None
        for words in itertools.product(range(5), repeat=len(arcs)):
            f = dict(zip(arcs, words, strict=True))
            if any(sum(w for (_, s), w in f.items() if s == q) > n for q, n in quotas.items()) or any(sum(w for (p, _), w in f.items() if p == k) > 2 * size for k, (_, size) in patterns.items()):
                continue
            value = (-sum(words), cost(f, patterns, 2))
            best = value if best is None or value < best else best
        assert (-sum(flow.values()), cost(flow, patterns, 2)) == best


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, n long, source string, pattern string")
    out, sizes, goal = mixing.mix(df, "doc_id", F.col("n"), F.array("source"), mixing.repeating(), **options)
    return out.collect(), sizes, goal


def rows(n, seed=1):
    r = random.Random(seed)
    sources = ["x"] * 6 + ["y", "z", None]
    return [(k, r.choice([0, 1, 5, 40, 300, 9000]), r.choice(sources), "p") for k in range(n)]


@pytest.mark.parametrize("leaf", [2000, 7])
def test_sources_come_near_their_targets(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    data = rows(1500)
    out, sizes, goal = mixed(spark, data)
    assert len(out) == len(data) and set(sizes) == {"x", "y", "z", None}
    for s in sizes:
        taken = sum(r.copies * r.n for r in out if r.source == s)
        # a leaf of seven documents leaves no choice: half of the longest may be missing
        assert abs(taken - goal[s]) <= (4500 if leaf == 7 else 0.001 * goal[s] + 2)
    assert max(r.copies for r in out) <= 3
    again, _, _ = mixed(spark, data)
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_overlapping_sources_share_documents(spark):
    df = spark.createDataFrame([(k, 10, ["a", "b"] if k < 50 else ["a"]) for k in range(100)], "doc_id long, n long, m array<string>")
    out, sizes, goal = mixing.mix(df, "doc_id", F.col("n"), F.col("m"), lambda names: {s: 1 for s in names})
    assert sizes == {"a": 1000, "b": 500} and goal == {"a": 500.0, "b": 500.0}
    # b can only come from the shared half; a takes the other half, and nothing is repeated
    assert {(r.doc_id < 50, r.copies) for r in out.collect()} == {(True, 1), (False, 1)}


def test_fitted_comes_nearest_with_memory_for_sizes_alone():
    import numpy as np

    r = random.Random(8)
    for _ in range(200):
        sizes = np.array([r.choice([0, 1, 5, 40, 300, 9000, 10**12]) for _ in range(r.randint(1, 12))], np.int64)
        left = r.randint(0, int(sizes.sum()))
        taken = mixing.fitted(sizes, left)
        off = abs(int(sizes[taken].sum()) - left)
        # no single document added, dropped or exchanged comes nearer
        for k in range(len(sizes)):
            other = taken.copy()
            other[k] = ~other[k]
            assert abs(int(sizes[other].sum()) - left) >= off
            for j in range(k):
                swap = other.copy()
                swap[j] = ~swap[j]
                assert taken[j] == taken[k] or abs(int(sizes[swap].sum()) - left) >= off


def test_many_patterns_flow_in_time():
    import time

    names = [f"s{k}" for k in range(14)]
    r = random.Random(6)
    patterns = {k: ([names[b] for b in range(14) if k >> b & 1], r.randint(1, 10**9)) for k in range(1, 1 << 13)}
    began = time.time()
    flow = mixing.min_cost_flow(patterns, {s: 10**11 * (k % 5 + 1) for k, s in enumerate(names)})
    assert time.time() - began < 60 and sum(flow.values()) > 0


def test_columns_pass_through_under_any_name(spark):
    df = spark.createDataFrame([(k, 10, "a", f"p{k}", 7, -k, f"x{k}") for k in range(30)], "doc_id long, n long, source string, pattern string, size int, _h long, c0 string")
    out, _, _ = mixing.mix(df, "doc_id", F.col("n"), F.array("source"), mixing.repeating())
    assert out.columns == [*df.columns, "copies"]
    assert sorted(map(tuple, out.drop("copies").collect())) == sorted(map(tuple, df.collect()))


def test_odd_tables(spark):
    assert mixed(spark, [])[0] == []
    out, sizes, _ = mixed(spark, [(None, 5, None, "q"), (None, 5, None, "q"), (1, 0, "a", None), (1, 0, "a", None)])
    assert sizes == {"a": 0, None: 10} and len(out) == 4 and all(r.copies in (0, 1, 2, 3) for r in out)


def test_stage_repeats_documents(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "en", f"s{k % 3}", 20) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.stage_mix(spark, docs, "")
    assert out.columns == docs.columns
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert by == {"s0": 38, "s1": 15, "s2": 7} or abs(sum(by.values()) - 60) <= 3
