"""Language-model scores by a hierarchical Pitman-Yor model.

A text is the sequence of its words (A-Z lower-cased) and one end; its letters are the
bytes of the words, a blank between words, and the end (a line feed, which no word
holds). Restaurants are contexts of up to five bytes, every one that occurs. Chunks of
texts hold their distinct words and six-byte sequences, with their counts in training
texts. The sequences' sums are seated: contexts that end with the same two bytes in one
task, all levels in turn, by Gibbs sweeps; the two levels above, at most 65,536 dishes,
on the driver. A few seatings of the whole part are kept as samples. They stay a table,
partitioned by those two bytes, and grow with the text. A text's score is the sum of
log10 of its bytes' predictive probabilities, averaged over the samples: a chunk sends
its distinct sequences to the parts of the seating, which answer with them.

Base scores need each word's training count: a chunk sends its distinct words to the
buckets by hash that it has words of, which answer with the totals.

Null or empty text: only the end. A null id counts as the empty string. Rows that share
an id are scored one by one. Long texts are worked on in sections. With no training text
at all the model is uniform over bytes. An empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import pitman_yor as py
from tagmill.llm.common import saved, small_batches, table
from tagmill.llm.kernel import _LOWER, buffers, distinct, pieces, sections, word_hashes, words

FOLDS, HELD = 5, 1
#: Bytes of text of a chunk; words of a bucket; counted sequences a task holds before it sends them.
CHUNK, BUCKET, PENDING = 8 << 20, 1 << 21, 3 << 20
PIECE = 1 << 19
#: Counted values of a chunk's sections that are held before they are merged.
FOLD = 1 << 19
_END, _BLANK = 10, 32
#: Sequences seated in a task, on average; tasks that score chunks, beyond which each scores several.
SEATED, SCORERS = 200_000, 1 << 16
#: What a row of the seating holds: masses of dishes, weights of contexts, tables by the low two bytes.
DISH, WEIGHT, TABLES = range(3)


def letters(text: np.ndarray, offsets: np.ndarray, found=None, before: int | None = None, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context and byte) of all predicted bytes, and the number of each row's.

    Of a row that comes in parts: before, the five bytes that precede this part; last, whether the row ends with it.
    """
    n = len(offsets) - 1
    starts, lengths, row = found if found is not None else words(text, offsets)
    count = np.bincount(row, minlength=n)
    size = np.bincount(row, weights=lengths + 1, minlength=n).astype(np.int64) + ((count == 0) & last)
    ends = np.cumsum(size + py.DEPTH)
    flat = np.full(int(ends[-1]) if n else 0, _BLANK, np.uint8)
    begin = ends - size - py.DEPTH
    for k in range(py.DEPTH):
        flat[begin + k] = _END if before is None else before >> 8 * (py.DEPTH - 1 - k) & 255
    if last:
        flat[ends - 1] = _END
    if len(starts):
        first = np.cumsum(count) - count
        ahead = np.cumsum(lengths + 1) - (lengths + 1)
        own = begin[row] + py.DEPTH + ahead - ahead[np.minimum(first, len(ahead) - 1)][row]
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat[np.repeat(own, lengths) + place] = _LOWER[text[np.repeat(starts, lengths) + place]]
    wide = flat.astype(np.int64)
    keys = np.zeros(max(0, len(flat) - py.DEPTH), np.int64)
    for k in range(py.DEPTH + 1):
        keys = keys << 8 | wide[k : len(wide) - py.DEPTH + k]
    real = np.ones(len(flat), bool)
    for k in range(py.DEPTH):
        real[begin + k] = False
    return keys[real[py.DEPTH :]], size


def spelled(text: np.ndarray, offsets: np.ndarray):
    """(i, j, words' hashes, words of each row, keys, keys of each row) of rows i to j, or of a part of a row."""
    tail = None
    for i, j, a, b, first, last in sections(text, offsets, PIECE):
        own, at = text[a:b], offsets[i : j + 1] - a if first and last else np.array([0, b - a])
        found = words(own, at)
        keys, size = letters(own, at, found, None if first else tail, last)
        if len(keys):
            tail = int(keys[-1]) & py.mask(py.DEPTH - 1)
        yield i, j, word_hashes(own, *found[:2]), np.bincount(found[2], minlength=j - i), keys, size


def _count(batches):
    """Sums of the chunks' counted sequences, merged up to PENDING of them."""
    held: list = []

    def sent():
        keys, n = held.pop()
        for i in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["key", "n"])

    for batch in batches:
        for seqs, keys, counts in zip(*(batch.column(x).to_pylist() for x in ("seqs", "keys", "counts")), strict=True):
            n = _unplanes(counts, seqs).astype(np.int64)
            held.append((_unpack(keys, seqs)[n > 0], n[n > 0]))
            if sum(len(k) for k, _ in held) > PENDING:
                held[:] = [_folded(held)]
                if len(held[0][0]) > PENDING // 2:
                    yield from sent()
    if held:
        held[:] = [_folded(held)]
        yield from sent()
    released()


def part_of(keys, parts: int):
    """The part of the seating that holds a key: by the last two bytes of its context (arrays and Columns)."""
    if isinstance(keys, np.ndarray):
        return ((keys >> 8 & 0xFFFF) * 40503 & 0xFFFF) * parts >> 16
    mixed = (F.shiftright(keys, 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(40503)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftright(mixed * F.lit(parts), 16)


def fit(train: DataFrame) -> dict:
    """The model, from rows (text)."""
    small_batches(train.sparkSession)
    return seated(saved(train.sparkSession, chunked(train.select(F.lit(0).alias("doc_id"), "text", F.lit(False).alias("held"))), "chunks"))


def seated(chunks: DataFrame) -> dict:
    """The model, from the chunks' counts of training sequences."""
    spark = chunks.sparkSession
    counts = chunks.select("seqs", "keys", "counts").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = saved(spark, counts, "sequences")
    # two levels on the driver: at most 65,536 rows
    low = lambda depth: F.col("key").bitwiseAND(F.lit(py.mask(depth))).alias("key")
    two = counts.select(low(2)).distinct().groupBy(low(1)).count().toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast(upper(two["key"].to_numpy(np.int64), two["count"].to_numpy(np.int64)))
    asked = chunks.agg(F.sum("seqs")).first()[0] or 0
    parts = min(1 << 16, max(8, counts.count() // SEATED + 1, asked // BUCKET))

    def run(frame):
        import pandas as pd

        order = np.argsort(frame["key"].to_numpy())
        found = py.levels(frame["key"].to_numpy(np.int64)[order], frame["n"].to_numpy(np.int64)[order], 2)
        table1, part = shared.value, int(frame["part"].iloc[0])
        best, tables = py.seat(found, 2, lambda k: table1[(k >> 8) & 255, k & 255], part)
        pairs = found[2][0] & py.mask(1)
        keys = distinct(pairs)
        sums = np.stack([np.bincount(np.searchsorted(keys, pairs), weights=t, minlength=len(keys)) for t in tables.T], axis=1)
        out = [(part, TABLES, 1, len(keys), _pack(keys), sums.tobytes())]
        for depth, (a, b) in best.items():
            dishes, _, rest = found[depth]
            first = np.flatnonzero(np.diff(rest, prepend=-1))
            out.append((part, DISH, depth, len(dishes), _pack(dishes), _planes(a.astype(np.float32).view(np.uint32))))
            out.append((part, WEIGHT, depth, len(first), _pack(dishes[first] >> 8), _planes(b.astype(np.float32).view(np.uint32))))
        del found, best, tables, pairs, order
        released()
        return pd.DataFrame(out, columns=["part", "kind", "depth", "n", "keys", "vals"])

    grouped = counts.withColumn("part", part_of(F.col("key"), parts).cast("int"))
    seating = saved(spark, grouped.groupBy("part").applyInPandas(run, "part int, kind int, depth int, n long, keys binary, vals binary"), "seating")
    tables = np.zeros((py.SAMPLES, 1 << 16))
    for r in seating.where(F.col("kind") == TABLES).select("n", "keys", "vals").toLocalIterator():
        tables[:, _unpack(r["keys"], r["n"])] += np.frombuffer(r["vals"], float).reshape(-1, py.SAMPLES).T
    keys = np.flatnonzero(tables[0])
    ones = [upper(keys, t[keys].astype(np.int64)) for t in tables]
    return {"one": np.stack(ones, axis=-1), "seating": seating, "parts": parts}


def upper(keys: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Depth-1 probabilities [context, byte] from the tables sent to each dish (byte, byte)."""
    if not len(keys):
        return np.full((256, 256), 1 / 256)
    rng = np.random.default_rng(5)
    rest = np.cumsum(np.diff(keys >> 8, prepend=-1) != 0) - 1
    k0 = distinct(keys & 255)
    zero, flat = np.zeros(len(k0), np.int64), np.full(len(k0), 1 / 256)
    chance, state0, state1 = np.full(256, 1 / 256), None, None
    for _ in range(py.BURN):
        t1, state1 = py.gibbs(rest, tables, chance[keys & 255], rng, state1)
        c0 = np.bincount(np.searchsorted(k0, keys & 255), weights=t1).astype(np.int64)
        t0, state0 = py.gibbs(zero, c0, flat, rng, state0)
        a, b = py.predictive(zero, c0, t0)
        chance = np.full(256, b[0] / 256)
        chance[k0] += a
    a, b = py.predictive(rest, tables, t1)
    out = np.tile(chance, (256, 1))
    open_ = (keys >> 8)[np.flatnonzero(np.diff(rest, prepend=-1))]
    out[open_] *= b[:, None]
    out[keys >> 8, keys & 255] += a
    return out


def assemble(rows: list[tuple], one: np.ndarray) -> dict:
    """Of rows (kind, depth, n, keys, vals) of some parts: full probabilities of all dishes and parents' weights, in hash tables keyed with the depth; a column a sample."""

    def gathered(kind: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        own = [r for r in rows if r[:2] == (kind, depth)]
        keys = np.concatenate([_unpack(r[3], r[2]) for r in own] or [np.zeros(0, np.int64)])
        values = np.concatenate([_unplanes(r[4], r[2] * py.SAMPLES).view(np.float32).reshape(-1, py.SAMPLES) for r in own] or [np.zeros((0, py.SAMPLES), np.float32)])
        order = np.argsort(keys)
        return keys[order], values[order].astype(float)

    dishes, weights, before = [], [], None
    for depth in range(2, py.DEPTH + 1):
        keys, a = gathered(DISH, depth)
        contexts, b = gathered(WEIGHT, depth)
        # every dish's context has a weight, and its ending a dish one level up
        up = one[(keys >> 8) & 255, keys & 255] if depth == 2 else before[1][np.searchsorted(before[0], keys & py.mask(depth - 1))]
        full = a + b[np.searchsorted(contexts, keys >> 8)] * up
        before = (keys, full)
        dishes.append((keys | depth << 56, full))
        weights.append((contexts | depth << 56, b))
    return {"one": one} | {name: py.hash_table(*map(np.concatenate, zip(*found, strict=True))) for name, found in (("dish", dishes), ("weight", weights))}


def chances(model: dict, keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte after its context, averaged over the samples, from the tables of its part."""
    out = np.empty(len(keys))
    for low in range(0, len(keys), 1 << 18):
        some = keys[low : low + (1 << 18)]
        p = np.empty((len(some), py.SAMPLES))
        todo, scale = np.arange(len(some)), np.ones(p.shape)
        for depth in range(py.DEPTH, 1, -1):
            own = some[todo] & py.mask(depth)
            found = py.get(model["dish"], own | depth << 56)
            hit = ~np.isnan(found[:, 0])
            p[todo[hit]] = found[hit] * scale[todo[hit]]
            todo, own = todo[~hit], own[~hit]
            w = py.get(model["weight"], own >> 8 | depth << 56)
            scale[todo] *= np.where(np.isnan(w), 1.0, w)
        own = some[todo]
        p[todo] = model["one"][(own >> 8) & 255, own & 255] * scale[todo]
        out[low : low + len(some)] = np.log10(p.mean(axis=1))
    return out


def log_chances(model: dict, keys: np.ndarray) -> np.ndarray:
    """chances() of a few keys, on the driver: it fetches their parts."""
    parts = np.unique(part_of(keys, model["parts"])).tolist()
    rows = model["seating"].where(F.col("part").isin(parts)).collect()
    return chances(assemble([(r["kind"], r["depth"], r["n"], r["keys"], r["vals"]) for r in rows], model["one"]), keys)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys: their steps by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunked(docs: DataFrame) -> DataFrame:
    """A row per chunk: its documents, their text, its distinct words and sequences, each with its count in training texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, docs array<struct<doc_id:{id_type},held:boolean,n:bigint,bytes:bigint>>, kinds bigint, words binary, train binary, seqs bigint, keys binary, counts binary, text binary"

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            text, offsets = buffers(batch.column("text"))
            ids, held = batch.column("doc_id"), batch.column("held")
            for i, j in pieces(offsets, CHUNK):
                out = np.asarray(held.slice(i, j - i).to_numpy(zero_copy_only=False), bool)
                size, (kinds, train), (seqs, counts) = tallied(text, offsets[i : j + 1], out)
                docs = pa.StructArray.from_arrays([ids.slice(i, j - i), pa.array(out), pa.array(size), pa.array(np.diff(offsets[i : j + 1]).astype(np.int64))], ["doc_id", "held", "n", "bytes"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 32 | number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), docs),
                        pa.array([len(kinds)], pa.int64()),
                        pa.array([_pack(kinds)], pa.binary()),
                        pa.array([_planes(train)], pa.binary()),
                        pa.array([len(seqs)], pa.int64()),
                        pa.array([_pack(seqs)], pa.binary()),
                        pa.array([_planes(counts)], pa.binary()),
                        pa.array([pa.compress(text[offsets[i] : offsets[j]].tobytes(), "zstd", asbytes=True)], pa.binary()),
                    ],
                    ["chunk", "docs", "kinds", "words", "train", "seqs", "keys", "counts", "text"],
                )
                number += 1
                released()

    return docs.select("doc_id", "text", "held").mapInArrow(run, schema)


def tallied(text: np.ndarray, offsets: np.ndarray, out: np.ndarray):
    """Words of each row; distinct words and sequences of all rows, each with its count in rows that are not held out."""
    size, kinds, seqs = np.zeros(len(out), np.int64), [], []
    for a, b, hashes, n, keys, width in spelled(text, offsets):
        size[a:b] += n
        _gather(kinds, *_counted(hashes.view(np.int64), np.repeat(out[a:b], n)))
        _gather(seqs, *_counted(keys, np.repeat(out[a:b], width)))
    return size, _folded(kinds), _folded(seqs)


def _gather(held: list, values: np.ndarray, counts: np.ndarray) -> None:
    """Adds to what is held; merges it once the new are more than FOLD and than those merged before."""
    held.append((values, counts))
    if sum(len(v) for v, _ in held[1:]) > max(FOLD, len(held[0][0])):
        held[:] = [_folded(held)]


def _folded(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with their counts summed; empties what is held, so that it need not lie beside the sums."""
    values, counts = map(np.concatenate, zip(*held, strict=True))
    held.clear()
    return py.summed(values, counts)


def released() -> None:
    """Freed memory back to the system: workers are kept, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def _counted(x: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, those held out (out) with count 0."""
    a, n = np.unique(x[~out], return_counts=True)
    b = distinct(x[out])
    return np.concatenate((a, b)), np.concatenate((n, np.zeros(len(b), np.int64)))


def totals(chunks: DataFrame) -> DataFrame:
    """chunk, bucket, counts (in the order of the chunk's words), and each bucket's sums once."""
    spark = chunks.sparkSession
    every = chunks.agg(F.sum("kinds")).first()[0] or 0
    shift = 64 - max(3, (every // BUCKET).bit_length())

    def deal(frames):
        import pandas as pd

        for f in frames:
            for r in f.itertuples():
                own, train = _unpack(r.words, r.kinds), _unplanes(r.train, r.kinds)
                first = np.flatnonzero(np.diff(own >> shift, prepend=(own[:1] >> shift) - 1))  # buckets the chunk has words of
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True))
                rows = [(r.chunk, int(own[a] >> shift), b - a, _pack(own[a:b]), _planes(train[a:b])) for a, b in cuts]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "kinds", "words", "train"])

    def answer(frame):
        import pandas as pd

        own = np.concatenate([_unpack(w, n) for w, n in zip(frame["words"], frame["kinds"], strict=True)])
        train = np.concatenate([_unplanes(t, n) for t, n in zip(frame["train"], frame["kinds"], strict=True)])
        kinds, at = np.unique(own, return_inverse=True)
        count = np.bincount(at, weights=train, minlength=len(kinds)).astype(np.int64)
        ends = np.cumsum(frame["kinds"].to_numpy())
        back = np.split(count[at], ends[:-1])
        return pd.DataFrame(
            {
                "chunk": frame["chunk"],
                "bucket": frame["bucket"],
                "kinds": frame["kinds"],
                "counts": [_wide(x) for x in back],
                "tokens": [int(count.sum())] + [0] * (len(frame) - 1),
                "known": [int((count > 0).sum())] + [0] * (len(frame) - 1),
            }
        )

    dealt = chunks.select("chunk", "kinds", "words", "train").mapInPandas(deal, "chunk long, bucket int, kinds long, words binary, train binary")
    return saved(spark, dealt.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, kinds long, counts binary, tokens long, known long"), "totals")


def _wide(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    return _pack(np.cumsum(x))


def answered(chunks: DataFrame, model: dict) -> DataFrame:
    """chunk, part, chances (32-bit, in the order of the chunk's sequences of the part)."""
    parts, shared = model["parts"], chunks.sparkSession.sparkContext.broadcast(model["one"])

    def deal(frames):
        import pandas as pd

        for f in frames:
            for r in f.itertuples():
                keys = _unpack(r.keys, r.seqs)
                part = part_of(keys, parts)
                keys, ends = keys[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part, minlength=parts))
                cuts = [(p, keys[a:b]) for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
                yield pd.DataFrame([(r.chunk, p, len(k), _pack(k)) for p, k in cuts], columns=["chunk", "part", "seqs", "keys"])

    def answer(asked, rows):
        import pandas as pd

        own = assemble(list(rows[["kind", "depth", "n", "keys", "vals"]].itertuples(index=False, name=None)), shared.value)
        found = [_planes(chances(own, _unpack(k, n)).astype(np.float32).view(np.uint32)) for k, n in zip(asked["keys"], asked["seqs"], strict=True)]
        del own
        released()
        return pd.DataFrame({"chunk": asked["chunk"], "part": asked["part"], "seqs": asked["seqs"], "chances": found})

    dealt = chunks.select("chunk", "seqs", "keys").mapInPandas(deal, "chunk long, part int, seqs long, keys binary")
    seating = model["seating"].where(F.col("kind") != TABLES)
    return dealt.groupBy("part").cogroup(seating.groupBy("part")).applyInPandas(answer, "chunk long, part int, seqs long, chances binary")


def score(docs: DataFrame, held: str = "held") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, held)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.col(held).alias("held"))
    chunks = saved(spark, chunked(docs), "chunks")
    model = seated(chunks)
    spread, found = model["parts"], totals(chunks)
    ends = docs.where("not held").count()
    sums = found.agg(F.sum("tokens"), F.sum("known")).first()
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(batch, k):
        row = {x: batch.column(x)[k] for x in batch.schema.names}
        parts = sorted(row["parts"].as_py() or [], key=lambda p: p["bucket"])
        count = np.concatenate([np.diff(_unpack(p["counts"], p["kinds"]), prepend=0) for p in parts] or [np.zeros(0, np.int64)])
        width = 0.5 * (v + 1) + n
        logs = np.log10((count + 0.5) / width)
        kinds = _unpack(row["words"].as_py(), row["kinds"].as_py())
        keys = _unpack(row["keys"].as_py(), row["seqs"].as_py())
        keys = keys[np.argsort(part_of(keys, spread), kind="stable")]
        said = [_unplanes(p["chances"], p["seqs"]).view(np.float32) for p in sorted(row["answers"].as_py(), key=lambda p: p["part"])]
        chance = py.hash_table(keys, np.concatenate(said))
        inner = row["docs"].values
        size = np.asarray(inner.field("n")).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(inner.field("bytes")))]).astype(np.int64)
        text = np.frombuffer(pa.decompress(row["text"].as_py(), int(offsets[-1]), "zstd", asbytes=True), np.uint8)
        base, known, scores = np.full(len(size), np.log10((ends + 0.5) / width)), np.full(len(size), int(ends > 0)), np.zeros(len(size))
        for i, j, hashes, tokens, asked, letters_ in spelled(text, offsets):
            at, own = np.searchsorted(kinds, hashes.view(np.int64)), np.repeat(np.arange(j - i), tokens)
            base[i:j] += np.bincount(own, weights=logs[at], minlength=j - i)
            known[i:j] += np.bincount(own, weights=count[at] > 0, minlength=j - i).astype(np.int64)
            scores[i:j] += np.bincount(np.repeat(np.arange(j - i), letters_), weights=py.get(chance, asked), minlength=j - i)
        return pa.RecordBatch.from_arrays(
            [inner.field("doc_id"), inner.field("held"), pa.array(size + 1), pa.array(known), pa.array(np.full(len(size), n)), pa.array(base), pa.array(scores)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield scored(batch, k)
                released()

    # as many parts as the chunks need, the same on all three sides
    wide = min(SCORERS, max(8, chunks.count()))
    parts = found.repartition(wide, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kinds", "counts")).alias("parts"))
    answers = answered(chunks, model).repartition(wide, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "seqs", "chances")).alias("answers"))
    # a chunk of documents without words has no answer of a bucket
    rows = chunks.select("chunk", "docs", "kinds", "words", "seqs", "keys", "text").repartition(wide, "chunk").join(parts, "chunk", "left").join(answers, "chunk")
    return rows.mapInArrow(finish, schema)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held")))
