"""Near-duplicate groups by b-bit MinHash.

A text's set holds the hashes of its distinct word shingles (A-Z lower-cased); equal
sets form one class, whose smallest document id stands for it. A class has 128 minima:
25 bands of 5 full minima (32 of 4 at 0.80) give candidates, and the low 4 bits of all are kept, packed
into eight words. Every member of a band's bucket meets the bucket's smallest id; equal
low bits, counted on the packed words and corrected for chance, estimate the
similarity, and pairs within five standard deviations of the threshold are confirmed on
the full sets. Buckets whose other members still fall into several components are then
compared exhaustively, on full sets, in blocks; only links that join components come
out of a block. Components are found by alternating large and small stars.

At the threshold a pair shares no band with probability under one in a million, and one
that does is set aside by an estimate more than five standard deviations too low with
less; all others that share a band are decided on the full sets.

Null or empty text, or text without words: empty set, linked with nothing. Rows that
share an id are one document: of different texts the one whose set has the smallest
fingerprint (with words, if any has) stands for it, and every row keeps its own
n_shingles. A null id belongs to no group and is kept. An empty table
gives no rows; further columns are ignored (stage_dedup passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.llm import dedup_kernel as kernel
from tagmill.llm.common import HOT_KEYS, HOT_ROWS, LOWER, MAX_BROADCAST_ROWS, UPPER, checkpoint_dir, hot_join, saved, small_batches, table
from tagmill.llm.kernel import buffers, pieces

WIDTH, PERCENT = 3, 85
#: Rows and shingles of one side of a block comparison.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
_COLUMNS = 2048


def _longs(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel().view(np.int64)))


def signatures(docs: DataFrame, width: int, rows: int = kernel.ROWS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (the set's fingerprint), bands, low (packed low bits)."""
    longs = T.ArrayType(T.LongType())
    schema = docs.select("doc_id").schema
    for name, kind in (("n_shingles", T.LongType()), ("f1", T.LongType()), ("f2", T.LongType()), ("bands", longs), ("low", longs)):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            text, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in pieces(offsets):
                sets = kernel.shingle_sets(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                least = np.array([kernel.minima(s) for s in sets], np.uint64).reshape(-1, kernel.MINIMA)
                prints = np.array([kernel.fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _longs(kernel.band_keys(least, rows)), _longs(kernel.pack(least))],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, f1 and f2 (the set's fingerprint) and the set as array<bigint>."""
    schema = docs.select("doc_id").schema.add("f1", "long").add("f2", "long").add("shingles", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            text, offsets = buffers(batch.column("text"))
            for i, j in pieces(offsets):
                sets = kernel.shingle_sets(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                prints = np.array([kernel.fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def estimate(a, b):
    """The similarity that equal low bits estimate, corrected for those equal by chance."""
    ones = sum(1 << k for k in range(0, 64, kernel.BITS))
    ones -= (ones >= 1 << 63) << 64

    def unequal(x):
        folded = x
        for k in range(1, kernel.BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))

    count = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-kernel.BITS
    return ((1 - count / kernel.MINIMA) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for the nodes of edges (a, b)."""
    checkpoint_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = small.distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        before = mark


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (distinct)."""
    small = ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def hot_hubs(pairs: DataFrame) -> DataFrame:
    """a, parts of the fewer than HOT_KEYS documents with many of the pairs (a, b), parts to deal theirs into."""
    least = max(HOT_ROWS, pairs.count() // HOT_KEYS)
    counted = pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > least)
    return saved(pairs.sparkSession, counted.select("a", F.ceil(F.col("c") / least).cast("int").alias("parts")), "hot")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough; hot documents a (a, parts) have a copy of their set for each part of their pairs."""
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    copies = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(F.broadcast(hot), "a", "left")
    copies = copies.select("a", "sa", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = dealt.join(copies, ["a", "part"]).join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    rows_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(a, b)
    for i in range(0, len(shared), _COLUMNS):
        part = shared[i : i + _COLUMNS]
        grids = []
        for values, rows, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            grid = np.zeros((n, len(part)), np.float32)
            grid[rows[hit], at[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _block_links(percent: int):
    def run(frame):
        """Links (a, b) of a block pair that join components; x: 0 left, 1 right side, 2 both."""
        frame = frame.drop_duplicates("doc_id").sort_values("doc_id")
        # a set's values are distinct, so a column that one row alone has adds nothing
        sides = [frame[frame["side"].isin((k, 2))] for k in (0, 1)]
        left, right = ([np.asarray(s, np.int64) for s in x["shingles"]] for x in sides)
        found = []
        if left and right:
            shared = intersections(left, right)
            na, nb = (np.array([len(s) for s in x], np.float64) for x in (left, right))
            ca, cb = (x["comp"].to_numpy() for x in sides)
            ia, ib = (x["doc_id"].to_numpy() for x in sides)
            parent: dict = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, row in enumerate(shared):
                ok = (100 * row >= percent * (na[i] + nb - row)) & (cb != ca[i])
                for j in np.flatnonzero(ok).tolist():
                    x, y = root(ca[i]), root(cb[j])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((ia[i], ib[j]))
        import pandas as pd

        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members (key, doc_id, n, comp) of unresolved buckets, compared in blocks."""
    size = members.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(size.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j: a row is in those of its own block with every other
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("key", "doc_id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    return rows.join(sets, "doc_id").groupBy("key", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = kernel.rows_for(percent)
    marked = saved(spark, signatures(docs, width, rows), "signatures")
    light = marked.select("doc_id", "n_shingles", "f1", "f2")
    own = F.struct((F.col("n_shingles") == 0).alias("empty"), "f1", "f2")
    twice = light.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("text"), F.max(own).alias("other")).where("text <> other")
    twice = saved(spark, twice.select("doc_id", "text"), "texts")
    if not twice.isEmpty():
        # every row of such an id goes by the text that stands for it
        light = light.join(twice, "doc_id", "left")
        light = light.select("doc_id", "n_shingles", *(F.coalesce(F.col("text")[f], F.col(f)).alias(f) for f in ("f1", "f2")))
    counted = saved(spark, light.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    classes = counted.where(f"rep is not null and (f1 <> {kernel.EMPTY[0]} or f2 <> {kernel.EMPTY[1]})").drop("c")
    # texts of very many copies, the empty one too
    copied = counted.where(F.col("c") > max(HOT_ROWS, marked.count() // HOT_KEYS)).select("f1", "f2")
    reps = marked.join(classes, (marked["doc_id"] == classes["rep"]) & (marked["f1"] == classes["f1"]) & (marked["f2"] == classes["f2"]), "left_semi").dropDuplicates(["doc_id"])
    reps = saved(spark, reps, "representatives")

    banded = reps.select(F.explode("bands").alias("key"), "doc_id", F.col("n_shingles").alias("n"))
    buckets = saved(spark, banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("c > 1"), "hubs")
    hot = buckets.where(F.col("c") > max(HOT_ROWS, reps.count() * (kernel.MINIMA // rows) // HOT_KEYS)).select("key")
    buckets = saved(spark, hot_join(banded, buckets, ["key"], hot=hot).where("doc_id <> hub"), "buckets")
    low = reps.select("doc_id", "n_shingles", "low")
    star = saved(spark, buckets.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    hubs = hot_hubs(star)
    star = hot_join(star, low.toDF("a", "na", "la"), ["a"], hot=hubs.select("a")).join(low.toDF("b", "nb", "lb"), "b")
    sure = percent / 100
    spread = (1 - 2.0**-kernel.BITS) ** -1 * (sure * (1 - sure) / kernel.MINIMA) ** 0.5 + 0.003
    star = star.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate(F.col("la"), F.col("lb")) >= sure - 5 * spread))
    star = saved(spark, star.select("a", "b"), "pairs")
    needed = star.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(buckets.where("c > 2").select("doc_id")).distinct()
    sets = shingles(chosen(docs, needed), width)
    if not twice.isEmpty():
        sets = sets.join(reps.select("doc_id", "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi")
    sets = saved(spark, sets.drop("f1", "f2").dropDuplicates(["doc_id"]), "sets")
    links = saved(spark, confirmed(star, sets, percent, hubs), "links")

    labels = components(links)
    open_ = buckets.where("c > 2").join(labels.toDF("doc_id", "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")).select("key", "doc_id", "n", "comp")
    open_ = saved(spark, open_, "labelled")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    more = rest_links(open_.join(mixed, "key", "left_semi"), sets, percent)
    labels = components(links.unionByName(saved(spark, more, "rest")))

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    out = hot_join(light, named, ["f1", "f2"], "left", hot=copied)
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", known.alias("component_id"))


def op8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    found = near_duplicates(docs, 5, 80)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    gone = saved(spark, gone, "dropped")
    small = gone.count() <= MAX_BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    again = saved(spark, again, "repeated")
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op8_sql() -> str:
    return f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WIDTH}
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
steps AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT a, b FROM steps UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of ON a = d.doc_id"""
