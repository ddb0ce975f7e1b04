import hashlib
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_dedup import brute as brute_groups
from test_langid import brute_force as brute_languages

import corpus_pipeline
from tagmill.llm import bpe, langid, mixing


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[1] < sizes[0] <= docs.count()
    assert now.select("doc_id").distinct().count() <= sizes[1]
    assert now.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def brute_mix(docs):
    """Copies by id of (id, text, source) rows, one source each, one by one: quotas, whole passes, the seeded order, the fit."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t, _ in docs}
    sums = Counter()
    for d, _, s in docs:
        sums[s] += size[d]
    names = [*sorted(s for s in sums if s is not None), *[None] * (None in sums)]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, left, open_ = {}, sum(size.values()), list(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sums[s]] or open_
        for s in over:
            goal[s] = min(share[s], 3.0 * sums[s])
        if over == open_:
            break
        left -= sum(goal[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    order = lambda d: xxhash.xxh64_intdigest(struct.pack("<q", d), seed=xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), seed=42)) >> 4
    copies = {}
    for s in names:
        passes, rest = divmod(min(round(goal[s]), 3 * sums[s]), sums[s]) if sums[s] else (0, 0)
        ids = sorted((d for d, _, x in docs if x == s), key=lambda d: (order(d), str(d)))
        for d in ids:
            copies[d] = passes
        taken, full = {}, not rest
        for d in ids:
            full = full or size[d] > rest
            taken[d] = not full
            rest -= size[d] * taken[d]
        for d in ids:
            if rest and not taken[d] and 0 < size[d] <= rest:
                taken[d], rest = True, rest - size[d]
        while rest:
            gone = [(0, None), *((size[d], d) for d in ids if taken[d] and size[d])]
            new = [(0, None), *((size[d], d) for d in ids if not taken[d] and size[d])]
            least, a, b = min((abs(rest + x - y), x, y) for x in {x for x, _ in gone} for y in {y for y, _ in new})
            # equally good exchanges: the one the operator takes is as near
            if least >= abs(rest):
                break
            for d in [d for x, d in gone if d is not None and x == a][-1:] + [d for y, d in new if d is not None and y == b][:1]:
                taken[d] = not taken[d]
            rest += a - b
        for d in ids:
            copies[d] += taken[d]
    return copies


def test_all_rows_equal_the_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    judged = brute_languages([d[:3] for d in docs], [d[:3] for d in docs if d[2] is not None and zlib.crc32(str(d[0]).encode()) % 4 != 2])
    known = [d for d in docs if judged[d[0]][0] != "und" and judged[d[0]][1] >= langid.LEAST_SCORE]
    first = brute_groups([(d[0], d[1]) for d in known], 5, 80)
    kept = [(d, t, s) for d, t, _, s in known if first[d][1] == d]
    want = Counter()
    texts = {d: t for d, t, _ in kept}
    for d, n in brute_mix(kept).items():
        ids = library.encode_ordinary(texts[d])
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want and len(known) >= len(kept) > 100


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "", 0), (2, "the word " * 50, "en", None, 9), (2, "the word " * 50, "en", None, 9), (3, "the word " * 50, "en", "a", 9)], schema)
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, "").collect()
    assert langid.stage_langid(spark, odd, "").count() == 3
