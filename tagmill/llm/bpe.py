"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Code points become symbols by a class table and a look at their neighbours (what ends a
run of blanks, which apostrophes start a contraction). Each symbol is a function on the
eight states of the pre-tokeniser; composing functions is associative, so blocks are
composed side by side, block summaries scanned, and the states inside all blocks filled
in at once. A boundary is where (state, symbol) says so. No regular expression runs.
The slices between boundaries are merged by rank, with a cache; long slices by a heap.

The slices are those of the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and special tokens are ordinary text. Long texts are worked on in parts that begin at a
blank between two other characters, where a slice always begins. Null text is empty: no
ids. An empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.llm.common import small_batches, table
from tagmill.llm.kernel import buffers

#: Characters that array code works on at once; a longer document is worked on in parts.
CHARS = 1 << 19
#: Slices kept in the merge cache of a task before a batch; slices up to LONGEST bytes merge side by side.
CACHE, LONGEST = 200_000, 64
BLOCK = 64

# states: 0 fresh, 1 after a joined blank, 2 letters, 3 numbers, 4 others, 5 blanks, 6 and 7: one and two letters of a contraction to come
# symbols: 0 letter, 1 number, 2 other, 3 and 4 apostrophe before one and two letters of a contraction,
#          5 blank U+0020 and 6 other white space, last of a run before text, 7 white space before white space or the end
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, RUN = range(8)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary-before by 8 * symbol + state; symbols from 8 on start a document."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for s in range(8):
        for sym in range(8):
            if s in (6, 7):  # letters of a contraction, whatever they would be else
                step[sym, s], cut[sym, s] = (0, False) if s == 6 else (6, False)
            elif sym in (LETTER, NUMBER, OTHER):
                own = sym + 2
                step[sym, s], cut[sym, s] = own, s not in (1, own)
            elif sym in (SHORT, LONG):  # a contraction only where a slice begins
                step[sym, s], cut[sym, s] = (4, False) if s in (1, 4) else (6 if sym == SHORT else 7, True)
            elif sym == BLANK:
                step[sym, s], cut[sym, s] = 1, True
            elif sym == SPACE:
                step[sym, s], cut[sym, s] = 0, True
            else:
                step[sym, s], cut[sym, s] = 5, s != 5
    step[8:], cut[8:] = step[:8, :1], True
    return step.ravel(), cut.ravel()


def code_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    import unicodedata

    out = np.full(0x110000, 2, dtype=np.uint8)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        if kind == "L":
            out[k] = 0
        elif kind == "N":
            out[k] = 1
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """points: code points of documents in a row; first: True where one begins."""
    kind = classes[points]
    n = len(points)
    out = kind.copy()
    last = np.ones(n, bool)  # nothing of the same document follows
    last[:-1] = first[1:]
    after = np.full(n, 3, np.uint8)
    after[:-1] = kind[1:]
    after[last] = 3
    space = kind == 3
    out[space] = RUN
    ends = space & (after != 3)
    out[ends] = np.where(points[ends] == 0x20, BLANK, SPACE)
    for at in (np.flatnonzero((points == 0x27) & ~last),):
        one = points[at + 1]
        short = np.isin(one, [ord(c) for c in "sdmt"])
        far = at + 2
        there = (far < n) & ~last[np.minimum(at + 1, n - 1)]
        two = np.where(there, points[np.minimum(far, n - 1)], 0)
        pair = ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
        out[at[short]] = SHORT
        out[at[pair & ~short]] = LONG
    out[first] += 8
    return out


def scan(sym: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The state before each symbol: compose blocks, scan their functions, fill in."""
    n = len(sym)
    rows = -(-n // BLOCK)
    # a start symbol of state 0 pads the end; nothing reads what follows
    padded = np.full(rows * BLOCK, 8, np.uint8)
    padded[:n] = sym
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(BLOCK):
        whole = step[(grid[k] << 3)[:, None] + whole]
    state = starts(whole)
    out = np.empty((BLOCK, rows), np.uint8)
    for k in range(BLOCK):
        out[k] = state
        state = step[(grid[k] << 3) + state]
    return out.T.ravel()[:n]


def starts(functions: np.ndarray) -> np.ndarray:
    """The state before each function when they apply one after the other from state 0."""
    n = len(functions)
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), 0
        for k in range(n):
            out[k] = s
            s = functions[k, s]
        return out
    rows = -(-n // BLOCK)
    padded = np.tile(np.arange(8, dtype=np.uint8), (rows * BLOCK, 1))
    padded[:n] = functions
    grid = padded.reshape(rows, BLOCK, 8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(BLOCK):
        whole = np.take_along_axis(grid[:, k], whole.astype(np.intp), axis=1)
    state = starts(whole)
    out = np.empty((rows, BLOCK), np.uint8)
    each = np.arange(rows)
    for k in range(BLOCK):
        out[:, k] = state
        state = grid[each, k, state]
    return out.ravel()[:n]


def merge(piece: bytes, ranks: dict) -> tuple:
    """Ids of one slice: the adjacent pair of least rank merges, leftmost first."""
    if (own := ranks.get(piece)) is not None:
        return (own,)
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict) -> tuple:
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


def pair_table(ranks: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left << 32 | right) of the id pairs that can merge, and the merged ids."""
    keys, ids = [], []
    for token, k in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                ids.append(k)
    keys, ids = np.array(keys, np.int64), np.array(ids, np.int32)
    order = np.argsort(keys)
    return keys[order], ids[order]


def merge_many(found: list[bytes], single: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of slices of at most LONGEST bytes in a row, and the number of each slice's: in every round each slice merges its best pair."""
    keys, merged = pairs
    count = np.zeros(len(found), np.int64)
    parts = []
    never = np.iinfo(np.int32).max

    def rank(left, right):
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where(keys[at] == key, merged[at], never).astype(np.int32)

    sizes = np.fromiter(map(len, found), np.int64, len(found))
    least = 0
    for width in (4, 8, 12, 16, 24, 32, LONGEST):
        rows = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        if not len(rows):
            continue
        data = np.frombuffer(b"".join(found[k].ljust(width, b"\0") for k in rows.tolist()), np.uint8).reshape(-1, width)
        ids, n = single[data], sizes[rows]
        ids[np.arange(width) >= n[:, None]] = -1
        best = rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(rows), 0), np.int32)
        live = np.arange(len(rows))
        cols = np.arange(width - 1)
        while len(live):
            here = best[live]
            at = here.argmin(axis=1)
            value = here[np.arange(len(live)), at]
            ok = value < never
            live, at, value = live[ok], at[ok], value[ok]
            if not len(live):
                break
            own, ranked = ids[live], best[live]
            shift = cols + (cols > at[:, None])
            own[:, :-1] = np.take_along_axis(own, shift, axis=1)
            own[:, -1] = -1
            each = np.arange(len(live))
            own[each, at] = value
            ranked[:, :-1] = np.take_along_axis(ranked, shift[:, :-1], axis=1)
            ranked[:, -1] = never
            right = own[each, at + 1]
            ranked[each, at] = np.where(right >= 0, rank(value, np.maximum(right, 0)), never)
            has = at > 0
            ranked[each[has], at[has] - 1] = rank(own[each[has], at[has] - 1], value[has])
            ids[live], best[live] = own, ranked
        kept = ids >= 0
        count[rows] = kept.sum(axis=1)
        parts.append((rows, ids[kept]))
    ends = np.cumsum(count)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for rows, ids in parts:
        flat[spans(ends[rows] - count[rows], count[rows])] = ids
    return flat, count


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., for size[0] numbers, then the same of the next."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Merges:
    """Ids by slice: a dictionary from slices to places in one array of ids."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.pairs = pair_table(ranks)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, found: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(found, range(len(self.begin), len(self.begin) + len(found)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))

    def look(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices in a row, and the number of each slice's."""
        if len(self.place) > CACHE:
            self.clear()
        lacking = list(set(found).difference(self.place))
        if lacking:
            short = [p for p in lacking if len(p) <= LONGEST]
            self.add(short, *merge_many(short, self.single, self.pairs))
            if rest := [p for p in lacking if len(p) > LONGEST]:
                ids = [merge(p, self.ranks) for p in rest]
                self.add(rest, np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64))
        at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        size = self.size[at]
        return self.ids[spans(self.begin[at], size)], size


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks, as installed beside its library."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def boundaries(texts: list[str], classes: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all slices of the texts in a row (and the end), and the first slice of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.cumsum(sizes) - sizes
    first = np.zeros(len(points), bool)
    first[offset[sizes > 0]] = True
    step, cut = tables
    sym = symbols(points, first, classes)
    at = np.flatnonzero(cut[(sym << 3) + scan(sym, step)])
    width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.cumsum(width, dtype=np.int64)
    begin = ends[at] - width[at]
    total = int(ends[-1]) if len(ends) else 0
    return np.append(begin, total), np.searchsorted(at, offset)


def encoder(ranks: dict, classes: np.ndarray):
    """A function from texts to (ids of all, number of ids of each text)."""
    merges, tables = Merges(ranks), automaton()

    def encode(texts: list[str]):
        if len(texts) == 1 and len(texts[0]) > CHARS:
            ids = np.concatenate([whole([part])[0] for part in parted(texts[0], classes)])
            return ids, np.array([len(ids)])
        return whole(texts)

    def whole(texts: list[str]):
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at, rows = boundaries(texts, classes, tables)
        data, at = "".join(texts).encode(), at.tolist()
        ids, sizes = merges.look([data[a:b] for a, b in zip(at, at[1:], strict=False)])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(ends[np.append(rows, len(sizes))])

    return encode


def parted(text: str, classes: np.ndarray):
    """Parts of CHARS characters or a little more; the text up to its end where no blank stands between two other characters."""
    at = 0
    while len(text) - at > CHARS:
        cut = text.find(" ", at + CHARS)
        while cut > 0 and not (cut + 1 < len(text) and classes[ord(text[cut - 1])] != 3 != classes[ord(text[cut + 1])]):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _batches(batch: pa.RecordBatch, name: str):
    column = batch.column(name)
    n = np.asarray(pa.compute.utf8_length(column.fill_null("")))
    ends, i = np.concatenate(([0], np.cumsum(n, dtype=np.int64))), 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(ends, ends[i] + CHARS, side="right")) - 1))
        yield batch.slice(i, j - i), [x or "" for x in column.slice(i, j - i).to_pylist()]
        i = j


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def vocabulary(ranks: dict) -> tuple[list[bytes], np.ndarray]:
    """Token by id, and its length."""
    token = [b""] * (max(ranks.values()) + 1)
    for x, k in ranks.items():
        token[k] = x
    return token, np.fromiter(map(len, token), np.int64, len(token))


def decoded_lists(ids: np.ndarray, n: np.ndarray, token: list[bytes], size: np.ndarray) -> pa.Array:
    """The bytes that the ids of each row (n of them) stand for."""
    data = b"".join(map(token.__getitem__, ids.tolist()))
    ends = np.concatenate(([0], np.cumsum(size[ids])))[np.concatenate(([0], np.cumsum(n)))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def encode(df: DataFrame, ranks: dict, column: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """df without the text, with ids array<int> and, if asked for, each id's byte offset
    and the bytes the ids decode to (in the same pass, so a task needs one worker)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((ranks, code_classes()))
    names = [c for c in df.columns if c not in (column, "ids", "offsets", "decoded")]
    ints = T.ArrayType(T.IntegerType())
    more = [("ids", ints)] + [("offsets", ints)] * offsets + [("decoded", T.BinaryType())] * decoded
    schema = T.StructType([*df.select(*names).schema, *(T.StructField(*x) for x in more)])

    def run(batches):
        ranks, classes = shared.value
        own = encoder(ranks, classes)
        token, size = vocabulary(ranks)
        for batch in batches:
            for part, texts in _batches(batch, column):
                ids, n = own(texts)
                out = [_lists(ids, n)]
                if offsets:
                    ends = np.cumsum(size[ids])
                    base = np.concatenate(([0], ends))[np.cumsum(n) - n]
                    out.append(_lists(ends - size[ids] - np.repeat(base, n), n))
                if decoded:
                    out.append(decoded_lists(ids, n, token, size))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *out], schema.names)

    return df.select(*names, column).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict, column: str = "ids") -> DataFrame:
    """df with the decoded bytes of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = df.drop("decoded").schema.add("decoded", "binary")

    def run(batches):
        token, size = vocabulary(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(column)
                n = np.asarray(pa.compute.list_value_length(lists).fill_null(0)).astype(np.int64)
                out = decoded_lists(lists.flatten().to_numpy(zero_copy_only=False), n, token, size)
                yield pa.RecordBatch.from_arrays([*part.columns, out], schema.names)

    return df.drop("decoded").mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def digests(docs: DataFrame, ranks: dict) -> DataFrame:
    read = encode(docs, ranks, decoded=True)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(said.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens and the digests of ids and decoded text."""
    import public_tokenizers

    return digests(docs.select("doc_id", "text"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
