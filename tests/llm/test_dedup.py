import random
import re

import pytest

from tagmill.llm import dedup


def sets(rows, width):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    s = sets(rows, width)
    ids = sorted(s)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(s[a] & s[b])
            if s[a] and s[b] and 100 * n >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s[d]), root(d)) for d in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 160))]
        for _ in range(r.choice([1, 2, 5, 14])):
            text = list(base)
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            if r.random() < 0.2:
                base = text  # chains of copies of copies
            rows.append((doc, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.05 else x for x in text)))
            doc += 1
    for text in (None, "", "  ", "one", "ONE", "one two", "one two", "one two three", "a b c", rows[0][1], rows[0][1]):
        rows.append((doc, text))
        doc += 1
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_blocks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 3)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_rows(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)]
    got = sorted(map(tuple, dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2)], key=str)


def test_stage_keeps_one_of_each(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s", "x") for d, t in rows] + [(0, rows[0][1], "s", "x")], "doc_id long, text string, source string, comp string")
    kept = [r.doc_id for r in dedup.stage_dedup(spark, df, "").collect()]
    assert sorted(kept) == sorted(d for d, (_, c) in brute(rows, 5, 80).items() if c == d)


def test_bands_follow_the_threshold():
    import numpy as np

    from tagmill.llm import dedup_kernel as kernel

    assert (kernel.rows_for(85), kernel.rows_for(80)) == (5, 4)
    least = np.arange(kernel.MINIMA, dtype=np.uint64)[None]
    assert kernel.band_keys(least, kernel.rows_for(80)).shape == (1, 32) and kernel.band_keys(least).shape == (1, 25)


def test_texts_of_one_id(spark):
    """Which of an id's texts stands for it does not depend on the order of rows."""
    words = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(1, near(0)), (2, near(2)), (2, "quite another text with words of its own"), (3, near(59)), (4, ""), (4, "x y z"), (5, "x y z"), (2, None)]
    out = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(4), 3, 85).collect()
        out.append(sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got}))
        assert len(got) == len(rows)
    assert out[0] == out[1] == out[2]
    assert {c for d, _, c in out[0] if d == 2} in ({1}, {2}) and {c for d, _, c in out[0] if d in (4, 5)} == {4}


def test_hot_buckets_are_spread(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(dedup, "HOT_KEYS", 10**6)
    rows = corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)


def test_long_texts_come_in_sections(spark, monkeypatch):
    from tagmill.llm import kernel

    monkeypatch.setattr(kernel, "PIECE", 60)
    rows = corpus(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)
