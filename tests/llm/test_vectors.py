import math

import numpy as np
import pytest

from tagmill.llm import ann, topk


def table(spark, seed=0, n=700):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in r.normal(size=12).astype(np.float32)], "x") for k in range(n)]
    for k in range(0, n, 3):  # a third of all rows are one vector
        rows[k] = (k, rows[0][1], "x")
    odd = [(n, None), (n + 50 - n % 50, [0.0] * 12), (n + 2, [1.0, None] + [0.0] * 10), (n + 3, [float("nan")] + [0.0] * 11), (n + 4, [float("inf")] * 12), (n + 5, []), (None, rows[1][1]), (1000 * 50, [1.0, 2.0]), (1001, [2.0, 4.0]), (1002, [-1.0, 0.0])]
    rows += [(k, v, "x") for k, v in odd] + [rows[5], rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), rows


def usable(rows, zero):
    out = {}
    for k, v, _ in rows:
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[k] = [float(np.float32(x)) for x in v]
    return out


def brute(vectors, score):
    out = {}
    for q in vectors:
        if q % 50 == 0:
            found = sorted((-score(vectors[q], v), k) for k, v in vectors.items() if k != q and len(v) == len(vectors[q]))
            out[q] = [(k, -s) for s, k in found[:5]]
    return out


@pytest.mark.parametrize("block", [2048, 100])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    df, rows = table(spark)
    want = brute(usable(rows, True), lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True)))
    got: dict = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in want.items() if v}


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 5.0]), (2, [1e7, 4.0]), (3, [1e30, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    whole = lambda v: [math.floor(256 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True))
    assert [(r.vec_id, r.score) for r in got] == [(3, 2**63 - 1), (1, dot(rows[0][1], rows[1][1])), (2, dot(rows[0][1], rows[2][1]))]


@pytest.mark.parametrize("cell", [4096, 40])
def test_neighbours_recall_and_scores(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    df, rows = table(spark, 3)
    vectors = usable(rows, False)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = brute(vectors, lambda a, b: round(cosine(a, b), 12))
    hit, total, last = 0, 0, {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        assert r.vec_id != r.query_id and r.score == pytest.approx(cosine(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)
        assert r.rank == last.get(r.query_id, 0) + 1
        last[r.query_id] = r.rank
        hit += r.vec_id in {k for k, _ in want[r.query_id]}
    total = sum(map(len, want.values()))
    assert sum(last.values()) == total and hit / total >= 0.95


def test_stopping_test():
    assert ann.chi_square(np.array([0.0]))[0] == 0 and ann.chi_square(np.array([7.344]))[0] == pytest.approx(0.5, abs=1e-3)
    gap, far = np.array([0.0, 1.0, 1e9, 50.0]), np.array([0.0, 0.0, np.inf, 1.0])
    assert ann.enough(gap, far).tolist() == [False, True, False, True]


def test_projections_keep_distances():
    r = np.random.default_rng(1)
    x, y = ann.unit(r.normal(size=(500, 64))), ann.unit(r.normal(size=(500, 64)))
    ratio = ((ann.project(x) - ann.project(y)) ** 2).sum(axis=1) / ((x - y) ** 2).sum(axis=1)
    assert np.mean(ann.chi_square(ratio) < 0.98) > 0.95


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0 and ann.nearest(df).count() == 0


def test_smaller_rows_stay_among_many_equal_cosines():
    import numpy as np

    from tagmill.llm import ann

    one = np.zeros((1, 64))
    one[0, :4] = 0.5
    r = np.repeat(one, 400, axis=0)
    at, _ = ann.search(one, np.full(1, np.inf), r, 6)
    assert sorted(at[0].tolist()) == list(range(6 + ann._SPARE))
