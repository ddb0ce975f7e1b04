import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tagmill.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return bpe.code_classes()


def texts():
    r = random.Random(5)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "a", "Z", "é", "中", "٣", "7", "½", "!", "\"", "😀", "‍", "é", "<|endoftext|>", "　", "\x85", "\x1c", "\0"]
    yield from ("", " ", "  ", "a", "'", "'s", " 's", "\n's", "''s", "don't", "x'llama", "'sd 'll'", "   a", "a   ", "\n\n x", "a" * 5000, " " * 3000 + "b", "ab" * 2000)
    for _ in range(1500):
        yield "".join(r.choice(alphabet) for _ in range(r.randint(1, 40)))
    yield "".join(r.choice(alphabet) for _ in range(60_000))


def test_ids_equal_the_library(reference, classes):
    own, all_texts = bpe.encoder(RANKS, classes), list(texts())
    ids, n = own(all_texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for text, got in zip(all_texts, parts, strict=True):
        assert got.tolist() == reference.encode_ordinary(text), text[:80]


def test_long_slices_merge_alike():
    r = random.Random(1)
    for _ in range(30):
        piece = bytes(r.choice(b"abcdeth ") for _ in range(r.randint(101, 400)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((RANKS.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(piece, RANKS) == tuple(RANKS[p] for p in parts)


def test_frames(spark, reference):
    rows = [(1, "don't  stop\n", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "é" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offsets string")
    out = bpe.decode(bpe.encode(df, RANKS, offsets=True), RANKS).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].ids == reference.encode_ordinary(rows[0][1]) and by[2].ids == [] and by[2].decoded == b""
    assert bytes(by[1].decoded).decode() == rows[0][1]
    for r, text in ((by[1], rows[0][1]), (by[None], rows[4][1])):
        ends = [*r.offsets[1:], len(text.encode())]
        assert [text.encode()[a:b] for a, b in zip(r.offsets, ends, strict=True)] == [reference.decode_single_token_bytes(i) for i in r.ids]
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_long_texts_come_in_parts(reference, classes, monkeypatch):
    r = random.Random(3)
    pieces = ["a", "b ", " c", "  ", "\n", " '", "s ", "7 ", " !", "é ", "　", " 　", "don't "]
    for size in (5, 40, 4000):
        monkeypatch.setattr(bpe, "CHARS", size)
        for _ in range(60):
            text = "".join(r.choice(pieces) for _ in range(300)) + r.choice(["", " ", "x"])
            ids, n = bpe.encoder(RANKS, classes)([text])
            assert ids.tolist() == reference.encode_ordinary(text) and n.tolist() == [len(ids)]
            assert "".join(bpe.parted(text, classes)) == text
