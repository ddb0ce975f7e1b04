import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import lm
from tagmill.llm import pitman_yor as py


def corpus():
    r = random.Random(2)
    syllables = ["an", "on", "the", "re", "ti", "é", "o"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(120)]
    rows = []
    for d in range(400):
        text = r.choice([" ", "\n", "\t "]).join(r.choice(vocabulary) for _ in range(r.randint(1, 120)))
        rows.append((d, text.upper() if d % 9 == 0 else text))
    return [*rows, (400, None), (401, ""), (402, " \n"), (403, "x" * 30_000), (404, rows[0][1]), (404, rows[0][1])]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in corpus()], "doc_id long, text string, score string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return lm.score(docs.withColumn("held", held)).collect()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def test_base_scores_equal_brute_force(scored):
    rows = corpus()
    count = Counter(t for d, x in rows if zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = sorted((d, zlib.crc32(str(d).encode()) % 5 == 1, len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for d, x in rows)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in scored)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_model_beats_bytes_without_context_on_held_out_texts(scored):
    rows = [(zlib.crc32(str(d).encode()) % 5 == 1, " ".join(tokens(x)[:-1]).encode() + b"\n") for d, x in corpus() if d != 403]
    count = Counter(b for held, t in rows if not held for b in t)
    flat = sum(math.log10((count[b] + 1) / (sum(count.values()) + 256)) for held, t in rows if held for b in t)
    # a word of 30,000 letters is one unknown word to the base, and spelled out to the model
    assert sum(r.score for r in scored if r.held_out and r.doc_id != 403) > 0.8 * flat
    assert all(r.score < 0 for r in scored)


def test_chances_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model = lm.fit(docs)
    for context in (b"\n\n\n\n\n", b"an on", b"\n\n\nth", b"qqqqq", b"xxxxx", "réan".encode()):
        keys = np.array([int.from_bytes(context + bytes([k]), "big") for k in range(256)])
        assert (10 ** lm.log_chances(model, keys)).sum() == pytest.approx(1, abs=1e-4)


def test_letters_spell_the_tokens():
    import pyarrow as pa

    from tagmill.llm.kernel import buffers

    text, offsets = buffers(pa.array(["Ab c", None, "d"]))
    keys, n = lm.letters(text, offsets)
    assert n.tolist() == [5, 1, 2] and bytes((keys & 255).astype(np.uint8)) == b"ab c\n\nd\n"
    assert keys[5] == int.from_bytes(b"\n" * 6, "big")


def test_gibbs_keeps_counts_possible():
    rest = np.array([0, 0, 0, 1])
    c = np.array([50, 1, 7, 2])
    tables, _ = py.gibbs(rest, c, np.array([0.3, 0.3, 0.4, 0.5]), np.random.default_rng(1))
    assert (tables >= 1).all() and (tables <= c).all() and tables[1] == 1


@pytest.mark.parametrize("customers", [(4, 3, 1), (20, 9, 3)])
def test_seating_follows_the_exact_posterior(customers):
    """All numbers of tables of one restaurant of three dishes, weighed one by one."""
    d, s, p = py.DISCOUNT, py.STRENGTH, (0.5, 0.1, 0.2)
    ways = {}

    def way(c, t):  # seatings of c customers at t tables
        if (c, t) not in ways:
            ways[c, t] = float(c == t) if c * t == 0 else way(c - 1, t - 1) + (c - 1 - d * t) * way(c - 1, t)
        return ways[c, t]

    weight, mean = 0.0, np.zeros(3)
    for t in itertools.product(*(range(1, c + 1) for c in customers)):
        w = math.prod(way(c, k) * q**k for c, k, q in zip(customers, t, p, strict=True)) * math.prod(s + d * k for k in range(sum(t)))
        weight, mean = weight + w, mean + w * np.array(t)
    n = 4000
    rng, state, got = np.random.default_rng(4), None, []
    for turn in range(40):
        tables, state = py.gibbs(np.repeat(np.arange(n), 3), np.tile(customers, n), np.tile(p, n), rng, state)
        if turn >= 10:
            got.append(tables.reshape(n, 3).mean(axis=0))
    assert np.mean(got, axis=0) == pytest.approx(mean / weight, rel=0.02)


def test_weights_of_seatings_equal_their_sums():
    d = py.DISCOUNT
    for c in (40, 90, 700):
        log = np.full(c + 1, -np.inf)
        log[0], t = 0.0, np.arange(1, c + 1)
        for k in range(c):
            with np.errstate(divide="ignore"):
                log[1:] = np.logaddexp(log[:-1], np.log(np.maximum(0, k - d * t)) + log[1:])
            log[0] = -np.inf
        theta = np.array([1e-4, 0.1, 1.0, 8.0, 30.0, 200.0, 2000.0])
        want = np.array([np.logaddexp.reduce(log[1:] + t * math.log(x)) for x in theta])
        got = py._log_ways(np.full(len(theta), c), theta)
        assert got - got[0] == pytest.approx(want - want[0], abs=0.02)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, held boolean")).count() == 0


def test_every_context_of_a_large_corpus_keeps_its_dishes(spark):
    r = np.random.default_rng(3)
    # more than 2^19 six-byte sequences, nearly all of them once
    texts = ["".join(map(chr, row)) for row in r.integers(97, 123, (70, 10_000))]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    import pyarrow as pa

    from tagmill.llm.kernel import buffers

    want = len(np.unique(lm.letters(*buffers(pa.array(texts)))[0]))
    rows = model["seating"].where(f"kind = {lm.DISH} and depth = {py.DEPTH}").selectExpr("sum(n)").first()
    assert want > 1 << 19 and rows[0] == want


def test_scores_are_the_sums_of_the_letters_chances(spark):
    import pyarrow as pa

    from tagmill.llm.kernel import buffers

    docs = spark.createDataFrame([(d, t, d % 5 == 1) for d, t in corpus()[:60]], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    model = lm.fit(docs.where("not held"))
    keys, n = lm.letters(*buffers(pa.array([t for _, t in corpus()[:60]])))
    sums = np.add.reduceat(lm.log_chances(model, keys), np.cumsum(n) - n)
    assert [got[d] for d in range(60)] == pytest.approx(sums.tolist(), rel=1e-4)


def test_every_customer_of_a_dish_is_seated_again():
    # a restaurant of one dish that its parent always serves is a Chinese restaurant process
    d, s = py.DISCOUNT, py.STRENGTH
    for c in (50, 400, 1000, 10_000, 40_000):
        want = math.exp(math.lgamma(s + 1) - math.lgamma(s + d) + math.lgamma(s + d + c) - math.lgamma(s + c)) / d - s / d
        n, state, got = 1500, None, []
        rng = np.random.default_rng(3)
        for turn in range(py.BURN + py.SAMPLES):
            tables, state = py.gibbs(np.arange(n), np.full(n, c), np.ones(n), rng, state)
            if turn >= py.BURN:
                got.append(tables)
        assert np.mean(got) == pytest.approx(want, rel=0.05) and np.min(got) >= 1 and np.max(got) <= c


def test_long_texts_come_in_sections(monkeypatch):
    import pyarrow as pa

    from tagmill.llm.kernel import buffers

    r = random.Random(7)
    texts = ["a b", "".join(r.choice(["ab ", "  ", "c\n", "é ", "Xyz "]) for _ in range(400)) + " ", None, "x" * 300 + " y", " " * 90]
    text, offsets = buffers(pa.array(texts))
    want = lm.letters(text, offsets)
    for piece in (1 << 19, 64, 7):
        monkeypatch.setattr(lm, "PIECE", piece)
        size, keys, tokens = np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int64)
        for i, j, _, n, k, width in lm.spelled(text, offsets):
            size[i:j] += width
            tokens[i:j] += n
            keys.append(k)
        assert size.tolist() == want[1].tolist() and np.concatenate(keys).tolist() == want[0].tolist()
        assert tokens.tolist() == [len((t or "").split()) for t in texts]


def test_tables_follow_their_conditional():
    r = np.random.default_rng(5)
    c, theta = 90, 2.5
    ways = np.zeros(c + 2)
    ways[0] = 1.0
    t = np.arange(1, c + 2)
    for k in range(c):  # scaled by k + 1 at each step
        ways[1:] = (ways[:-1] + np.maximum(0, k - py.DISCOUNT * t) * ways[1:]) / (k + 1)
        ways[0] = 0
    p = ways * theta ** np.arange(c + 2)
    want = (p / p.sum() * np.arange(c + 2)).sum()
    n = 4000
    tables, last = np.ones(n, np.int64), np.full(n, float(c))
    for _ in range(40):
        py._drawn(np.full(n, float(c)), np.full(n, theta), tables, last, r)
    assert tables.mean() == pytest.approx(want, rel=0.03)


def test_counts_of_a_chunk_are_merged_as_they_come(monkeypatch):
    """Otherwise a worker holds every section's sequences, their sums and the sort's copies at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    vocabulary = rng.integers(97, 123, (5000, 6)).astype(np.uint8)
    vocabulary[:, -1] = 32
    text = vocabulary[rng.zipf(1.3, 700_000) % 5000].ravel()
    offsets, out = np.arange(0, len(text) + 1, 6000), np.arange(len(text) // 6000) % 5 == 1
    monkeypatch.setattr(lm, "PIECE", 1 << 16)
    peaks, found = [], []
    for fold in (1 << 16, 1 << 40):
        monkeypatch.setattr(lm, "FOLD", fold)
        tracemalloc.start()
        found.append(lm.tallied(text, offsets, out))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    for (size, *pairs), (size_, *pairs_) in [found]:
        assert (size == size_).all() and size.sum() == 700_000
        assert all((x == y).all() for a, b in zip(pairs, pairs_, strict=True) for x, y in zip(a, b, strict=True))
    own = np.concatenate([keys[~np.repeat(out[a:b], width)] for a, b, _, _, keys, width in lm.spelled(text, offsets)])
    keys, counts = np.unique(own, return_counts=True)
    seqs, n = found[0][2]
    assert (seqs[n > 0] == keys).all() and (n[n > 0] == counts).all()
    assert peaks[0] < 0.6 * peaks[1]
