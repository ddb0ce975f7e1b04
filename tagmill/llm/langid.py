"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i holds a mask with a bit for every
language whose filter has bit i set, so three look-ups and two ANDs return all the
languages that contain an n-gram. Texts are lower-cased (A-Z), what is neither a letter
of ASCII nor beyond it becomes a blank, and the byte 3-grams and 4-grams without inner
blanks are looked up. A language's count of contained n-grams is corrected for the
false positives its filter's fill lets expect; the largest corrected count decides
(ties: the first language in code point order), and its share of the n-grams is the
score.

The filters are fitted on at most SAMPLE labelled rows a language, those of the smallest
hashes of their ids, read as whole texts (of rows that share an id, the smallest text);
of these, a language keeps its GRAMS or so most frequent n-grams (of those tied at the
end, a share by hash) that are no less than RATIO as frequent there as in any other.
Any number of languages; each takes 64 KB of the driver and of the broadcast.

Null text, or text without a letter: `und`, score 0. With no labelled documents at all,
every text is `und`. A null id counts as the empty string. Long texts are worked on in
sections. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import MAX_BROADCAST_ROWS, saved, small_batches, table
from tagmill.llm.kernel import buffers, mix64, sections

SAMPLE = 1500
GRAMS = 20_000
RATIO = 0.5
SLOTS = 1 << 19
#: In the pipeline: documents whose best language holds a smaller share of their n-grams go.
LEAST_SCORE = 0.3

_CLASS = np.full(256, 0x20, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the rows, and each one's row."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    flat = np.full(len(text) + 2 * n + 2, 0x20, dtype=np.uint8)
    place = np.arange(len(text)) + 2 * rows + 1
    flat[place] = _CLASS[text]
    # from the blank before each row to that after it
    row = np.zeros(len(flat), dtype=np.int32)
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    row[ends[:-1]] = 1
    row = np.cumsum(row, dtype=np.int32)
    a, inside = flat.astype(np.uint32), flat != 0x20
    three = np.flatnonzero(inside[1:-1])
    four = np.flatnonzero(inside[1:-2] & inside[2:-1])
    k3 = a[three] | a[three + 1] << 8 | a[three + 2] << 16
    k4 = a[four] | a[four + 1] << 8 | a[four + 2] << 16 | a[four + 3] << 24
    keys = np.concatenate((k3.astype(np.uint64), k4.astype(np.uint64) | np.uint64(1 << 40)))
    return keys, np.concatenate((row[three + 1], row[four + 1]))


def slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    h = mix64(keys)
    least = np.uint64(size - 1)
    return tuple(((h >> np.uint64(s)) & least).astype(np.int64) for s in (0, 21, 42))


def bitmap(keys: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, dtype=bool)
    for at in slots(keys, size):
        bits[at] = True
    return bits


def fit_filter(chosen: dict[str, np.ndarray], size: int = SLOTS) -> dict:
    """chosen: the keys of each language."""
    return sliced({name: bitmap(keys, size) for name, keys in chosen.items()}, size)


def sliced(maps: dict[str, np.ndarray], size: int = SLOTS) -> dict:
    """The bit-sliced filter of all languages' own bits."""
    names = sorted(maps)
    planes = np.zeros((max(1, -(-len(names) // 64)), size), dtype=np.uint64)
    fill = np.zeros(len(names))
    for k, name in enumerate(names):
        planes[k // 64] |= maps[name].astype(np.uint64) << np.uint64(k % 64)
        fill[k] = maps[name].mean()
    if len(names) <= 8:
        planes = planes.astype(np.uint8)
    return {"names": names, "planes": planes, "wrong": fill**3, "size": size}


def tally(model: dict, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contained n-grams by language and row, and all n-grams of each row."""
    n, names = len(offsets) - 1, model["names"]
    keys, row = grams(text, offsets)
    at = slots(keys, model["size"])
    held = np.zeros((len(names), n))
    for p, plane in enumerate(model["planes"]):
        mask = plane[at[0]] & plane[at[1]] & plane[at[2]]
        own = range(64 * p, min(len(names), 64 * p + 64))
        if len(names) <= 8:
            by_mask = np.bincount(row.astype(np.int64) * 256 + mask, minlength=256 * n).reshape(n, 256)
            for k in own:
                held[k] = by_mask[:, (np.arange(256) >> k) & 1 == 1].sum(axis=1)
        else:
            for k in own:
                held[k] = np.bincount(row, weights=((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(float), minlength=n)
    return held, np.bincount(row, minlength=n)


def predict_batch(model: dict, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and score for each row."""
    n = len(offsets) - 1
    held, total = np.zeros((len(model["names"]), n)), np.zeros(n, np.int64)
    for i, j, a, b, first, last in sections(text, offsets):
        some, all_ = tally(model, text[a:b], offsets[i : j + 1] - a if first and last else np.array([0, b - a]))
        held[:, i:j] += some
        total[i:j] += all_
    wrong = model["wrong"][:, None]
    held = np.maximum(0, (held - total * wrong) / np.maximum(1e-9, 1 - wrong))
    best = held.argmax(axis=0)
    return best, np.clip(held[best, np.arange(n)] / np.maximum(1, total), 0, 1)


def _count(batches):
    """(lang, text) to (lang, gram, n), summed within each batch."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        text, offsets = buffers(batch.column("text"))
        label = {x: k for k, x in enumerate(sorted(set(names)))}
        codes = np.array([label[x] for x in names], dtype=np.int64)
        for i, j, a, b, first, last in sections(text, offsets):
            keys, row = grams(text[a:b], offsets[i : j + 1] - a if first and last else np.array([0, b - a]))
            lang = codes[i:j][row]
            for name, k in label.items():
                found, n = np.unique(keys[lang == k], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(found), "gram": found.astype(np.int64), "n": n.astype(np.int64)})


def fold(key: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def fit(labelled: DataFrame, sample: int = SAMPLE, kept: int = GRAMS, ratio: float = RATIO) -> dict:
    """A filter from labelled rows (doc_id, text, lang)."""
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col("lang").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "lang", "text")
    # twice the sample by a bound on the hash, of which the window keeps the smallest
    sizes = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("rows")))  # a row a language
    low = F.shiftrightunsigned(F.xxhash64("id"), 1) / float(1 << 63) < 2 * sample / F.col("rows")
    near = known.select("id", "lang").join(sizes, "lang").where(low).select("id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1), "id"))
    drawn = saved(spark, near.withColumn("_k", place).where(F.col("_k") <= sample).drop("_k"), "drawn")
    few = drawn.count() <= MAX_BROADCAST_ROWS  # at most SAMPLE ids a language
    texts = known.join(F.broadcast(drawn) if few else drawn, ["id", "lang"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = saved(spark, counts, "grams")
    # where a language's n-grams are cut, from the numbers of n-grams by count
    by_count = counts.groupBy("lang", "n").agg(F.count("*").alias("c"))
    per = Window.partitionBy("lang")
    above = F.coalesce(F.sum("c").over(per.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = by_count.withColumn("above", above).withColumn("all", F.sum(F.col("n") * F.col("c")).over(per)).where(F.col("above") < kept)
    ends = ends.groupBy("lang").agg(F.min("n").alias("least"), F.min_by((F.lit(kept) - F.col("above")) / F.col("c"), "n").alias("share"), F.max("all").alias("all"))
    chance = F.xxhash64("gram").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    top = counts.join(ends, "lang").where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (chance < F.col("share"))))
    top = top.select("lang", "gram", (F.col("n") / F.col("all")).alias("rate"))
    most = top.groupBy("gram").agg(F.max("rate").alias("most"))
    chosen = top.join(most, "gram").where(F.col("rate") >= ratio * F.col("most"))

    def pack(frame):
        import pandas as pd

        bits = np.packbits(bitmap(frame["gram"].to_numpy().astype(np.uint64), SLOTS)).tobytes()
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "bits": [bits]})

    maps = chosen.select("lang", "gram").groupBy("lang").applyInPandas(pack, "lang string, bits binary").toLocalIterator()
    return sliced({r["lang"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in maps})


def predict(df: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """df's columns with lang_pred and score."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.drop("lang_pred", "score").schema
    flagged = df.drop("lang_pred", "score").withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        model = shared.value
        for batch in batches:
            text, offsets = buffers(batch.column("text"))
            has = batch.column("_letter").to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(has), dtype=np.int64), np.zeros(len(has))
            if model["names"]:
                best, score = predict_batch(model, text, offsets)
            ok = has & bool(model["names"])
            names = np.array([*model["names"], "und"], dtype=object)
            lang = names[np.where(ok, best, len(names) - 1)]
            kept = [batch.column(k) for k, x in enumerate(batch.schema.names) if x != "_letter"]
            cols = [x for x in batch.schema.names if x != "_letter"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0))], [*cols, "lang_pred", "score"])

    return flagged.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def trained(docs: DataFrame) -> dict:
    return fit(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), 4) != 2))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), trained(docs)).drop("text")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def stage_langid(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, whose n-grams it contains by LEAST_SCORE or more."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {x: f"c{k}" for k, x in enumerate(names)}
    view = renamed.withColumnRenamed(at["text"], "text")
    judged = predict(view, trained(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return judged.toDF(*names)
