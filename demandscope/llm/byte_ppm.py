"""Language-model scores by prediction by partial matching over bytes.

A text is its words, A-Z lower-cased, joined by single spaces, and an end symbol: a sequence of bytes that stands for its
tokens one to one. The model is the trie of byte contexts of up to five bytes that all learning documents give: how often
each symbol follows each context. A symbol that the longest context knows costs (c - 1/2) / n; otherwise the model
escapes with t / 2n to the context without its first byte, t being the number of different symbols there, and symbols of
longer contexts are excluded from the counts of shorter ones. Below the empty context all symbols left are equal.

What a byte costs depends on it and the five bytes before it only. So the texts stay together in chunks, and only the
different windows of each chunk are looked up: they meet the counts of all chunks in a shuffle, windows that no learning
text has go down the trie level by level, and the costs come back to their chunk, where the texts are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, lean, once, ship
from demandscope.llm.words import BLOCK_BYTES, raw_bytes, slices, spans_hash
from demandscope.session import stage

ORDER = 5  # bytes of the longest context; a window, its bytes and one more, must fit in 63 bits
CHUNK_BYTES = 64 << 20  # of text whose windows are looked up together
PAD, END = 0xFE, 0xFF  # never in UTF-8; other texts have OTHER in their place
OTHER = 0xFD
SYMBOLS = 255  # all bytes but PAD
SPACE = 0x20
_RENDERED = np.arange(256, dtype=np.uint8)
_RENDERED[0x41:0x5B] += 0x20
_RENDERED[0x09:0x0E] = SPACE
_RENDERED[[PAD, END]] = OTHER
END_TOKEN = -1  # keys of windows are not negative, those of words are below this
MERGE_KEYS = 1 << 19  # new keys that a task holds before it merges them
TEXT_BYTES = BLOCK_BYTES // 4  # of text that a task works on at a time
PACK = 64  # keys in a row for a chunk, so that a batch of rows for Python stays small
ROWS = 100_000


def rendered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with its end symbol, and their sizes."""
    data, offsets = raw_bytes(column)
    data = _RENDERED[data]
    space = data == SPACE
    first = np.zeros(data.size + 1, bool)
    first[offsets[:-1]] = True
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[space & first[:-1]] = False  # spaces before the first word, and all but one between words
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    body = data[keep]
    sizes = np.diff(kept)
    some = np.flatnonzero(sizes)
    trailing = kept[1:][some] - 1
    trailing = trailing[body[trailing] == SPACE]
    sizes[np.searchsorted(kept[1:], trailing, side="right")] -= 1
    body = np.delete(body, trailing)
    return np.insert(body, np.cumsum(sizes), END), sizes + 1


def window_keys(body: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, keys of the windows that end there and after it), in blocks of the body."""
    doc = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    padded = np.full(body.size + order * sizes.size, PAD, np.uint8)
    places = lambda low, high: np.arange(low, high) + order * (doc[low:high] + 1)
    blocks = [(low, min(body.size, low + TEXT_BYTES)) for low in range(0, body.size, TEXT_BYTES)]
    for low, high in blocks:
        padded[places(low, high)] = body[low:high]
    for low, high in blocks:
        at = places(low, high)
        key = np.zeros(high - low, np.int64)
        for back in range(order, -1, -1):
            key = (key << 8) | padded[at - back]
        yield low, key


def word_keys(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and key of each token; words have a 63-bit hash."""
    letter = (body != SPACE) & (body != END)
    edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keys = np.empty(start.size, np.int64)
    at = 0
    while at < start.size:
        to = max(at + 1, int(np.searchsorted(end, start[at] + TEXT_BYTES, side="right")))
        keys[at:to] = -2 - (spans_hash(body, start[at:to], end[at:to]) >> np.uint64(1)).astype(np.int64)
        at = to
    stops = np.flatnonzero(body == END)
    return np.concatenate((start, stops)), np.concatenate((keys, np.full(stops.size, END_TOKEN, np.int64)))


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and how often each stands where ``learn`` is set."""
    seen, n = np.unique(keys[learn], return_counts=True)
    return merged([(seen, n), (np.unique(keys[~learn]), None)])


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([np.zeros(k.size, np.int64) if n is None else n for k, n in parts])
    if not keys.size:
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


class Table:
    """Values of int64 keys, looked up by hashing without a Python step per key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * keys.size).bit_length())
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, values
        for low in range(0, keys.size, ROWS):
            left, slot = np.arange(low, min(keys.size, low + ROWS), dtype=np.int32), self.slot(keys[low:low + ROWS])
            while left.size:
                free = self.place[slot] < 0
                self.place[slot[free]] = left[free]
                lost = self.place[slot] != left
                left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; all keys must be in the table."""
        slot = self.slot(keys)
        found = self.place[slot]
        left = np.flatnonzero((found < 0) | (self.keys[found] != keys))
        while left.size:
            if (found[left] < 0).any():
                raise KeyError("a key without a value")
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.place[slot[left]]
            left = left[(found[left] < 0) | (self.keys[found[left]] != keys[left])]
        return self.values[found]


def gathered(rows: DataFrame, order: int, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: the different keys of a chunk with their counts, and its texts in compressed blocks."""
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("chunk", "key", "n")] + [
        T.StructField("ids", T.ArrayType(id_type))] + [T.StructField(x, T.BinaryType()) for x in ("sizes", "learn", "blob")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, held, kept = TaskContext.get().partitionId() << 24, 0, [], 0
        pack = zstandard.ZstdCompressor(level=1)
        ids_type = None

        def row(n, chunk, key=None, count=None, *block):
            ids, *rest = block or (None,) * 4
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()) if key is None else pa.array(key),
                pa.nulls(n, pa.int64()) if count is None else pa.array(count),
                pa.nulls(n, pa.list_(ids_type)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.nulls(n, pa.binary()) if x is None else pa.array([x], pa.binary()) for x in rest)], schema=names)

        def flush():
            keys, n = merged(held)
            for at in range(0, keys.size, ROWS):
                part = slice(at, at + ROWS)
                yield row(keys[part].size, chunk, keys[part], n[part])

        for batch in batches:
            if ids_type is None:
                ids_type = batch.schema.field(0).type
                names = pa.schema([*((x, pa.int64()) for x in ("chunk", "key", "n")), ("ids", pa.list_(ids_type)),
                                   *((x, pa.binary()) for x in ("sizes", "learn", "blob"))])
            for part in slices(batch, 1, TEXT_BYTES):
                body, sizes = rendered(part.column(1))
                learn = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                yield row(1, chunk, None, None, part.column(0), sizes.astype("<i8").tobytes(), learn.tobytes(),
                          pack.compress(body.tobytes()))
                each = np.repeat(learn, sizes)
                held += [counted(keys, each[low:low + keys.size]) for low, keys in window_keys(body, sizes, order)]
                place, keys = word_keys(body)
                held.append(counted(keys, each[place]))
                size += body.size
                if sum(k.size for k, _ in held) > kept + MERGE_KEYS:
                    held = [merged(held)]
                    kept = held[0][0].size
                if size >= chunk_bytes:
                    yield from flush()
                    chunk, size, held, kept = chunk + 1, 0, [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(lean(run), schema)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def window_costs(counts: DataFrame, order: int) -> DataFrame:
    """key and value, the log10 probability of each window's last byte after the others; n = 0 for those never learned."""
    seen = counts.where((F.col("key") >= 0) & (F.col("n") > 0))
    context = F.shiftright("key", 8)
    totals = seen.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    known = seen.withColumn("context", context).join(totals, "context").select(
        "key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
    pending = stage(counts.where((F.col("key") >= 0) & (F.col("n") == 0)).select(
        "key", F.array().cast("array<long>").alias("excluded"), F.lit(0.0).alias("value")), "ppm-unseen")
    done, level = [known], seen.select("key", "n")
    symbol = F.col("key").bitwiseAND(255)
    for k in range(order, -1, -1):
        if k < order:
            level = stage(level.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")), "ppm-level")
        nodes = level.groupBy(context.alias("context")).agg(F.collect_list(F.struct(symbol.alias("s"), "n")).alias("node"))
        if k <= 1:
            nodes = F.broadcast(nodes)  # at most 256 contexts of 255 symbols
        own = pending.withColumn("context", F.shiftright(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1), 8))
        met = own.join(nodes, "context", "left")
        live = F.filter("node", lambda x: ~F.array_contains("excluded", x["s"]))
        met = once(met, live=F.when(F.col("node").isNotNull(), live).otherwise(F.array().cast("array<struct<s:long,n:long>>")))
        here = F.try_element_at(F.filter("live", lambda x: x["s"] == symbol), F.lit(1))["n"]
        met = once(met, here=here, total=_sum(F.transform("live", lambda x: x["n"])))
        cost = F.when(F.col("here").isNotNull(), F.log10((F.col("here") - 0.5) / F.col("total"))).when(
            F.size("live") > 0, F.log10(F.size("live") * 0.5 / F.col("total"))).otherwise(0.0)
        level_done = stage(met.select(
            "key", F.col("here").isNotNull().alias("done"), (F.col("value") + cost).alias("value"),
            F.concat("excluded", F.transform("live", lambda x: x["s"])).alias("excluded")), "ppm-costs")
        done.append(level_done.where("done").select("key", "value"))
        pending = level_done.where("NOT done")
    done.append(pending.select("key", (F.col("value") - F.log10(F.lit(SYMBOLS) - F.size("excluded"))).alias("value")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, key, value) as rows of a chunk with up to ``PACK`` keys and their values."""
    def flush(held):
        chunk, key, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, key, value = chunk[order], key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        within = np.arange(chunk.size) - np.repeat(first, np.diff(first, append=chunk.size))
        cuts = np.append(np.flatnonzero(within % PACK == 0), chunk.size)
        ends = pa.py_buffer((8 * cuts).astype(np.int32))
        packed = (pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, ends, pa.py_buffer(x)]) for x in (key, value))
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), *packed], names=["chunk", "keys", "costs"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += batch.num_rows
        if n >= 1 << 18:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def byte_ppm(docs: DataFrame, learn: Column | None = None, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows where ``learn`` is true (without it, all). ``base_score`` is the smoothed log10
    probability of the tokens by their counts alone, ``score`` that of the same tokens under the model. Words are
    counted by 63-bit hashes. A null or empty text is an end alone. Where ``learn`` is null a row is held out. Ids may be
    null or repeat. No rows give no rows; other columns are not read. Without learning rows all symbols are equally likely.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col, (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = stage(gathered(rows.coalesce(size // chunk_bytes + 1), order, chunk_bytes), "ppm-chunks")
    keys = parts.where(F.col("key").isNotNull()).select("chunk", "key", "n")
    counts = stage(keys.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    tokens = counts.where("key < 0")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    values = window_costs(counts, order).unionByName(tokens.select("key", F.col("n").cast("double").alias("value")))
    answers = keys.select("chunk", "key").join(values, "key").select("chunk", "key", "value").mapInArrow(
        lean(_packed), "chunk long, keys binary, costs binary")
    texts = parts.where(F.col("key").isNull()).select("chunk", "ids", "sizes", "learn", "blob")
    both = answers.unionByName(texts, allowMissingColumns=True)
    sorted_ = both.repartition("chunk").sortWithinPartitions("chunk", F.col("blob").isNotNull())
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [rows.schema["doc_id"].dataType, T.BooleanType(), *[T.LongType()] * 3, T.DoubleType(), T.DoubleType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        current, held, table = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, known, costs, ids, sizes, learned, blob = (batch.column(k)[i] for k in range(7))
                if chunk.as_py() != current:
                    current, held, table = chunk.as_py(), [], None
                if known.is_valid:
                    held.append((np.frombuffer(known.as_buffer(), np.int64), np.frombuffer(costs.as_buffer(), np.float64)))
                    continue
                if table is None:
                    table, held = Table(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                yield scored(table, ids.values, sizes.as_py(), learned.as_py(), unpack.decompress(blob.as_buffer()))

    def scored(table, ids, sizes, learned, blob):
        body, sizes = np.frombuffer(blob, np.uint8), np.frombuffer(sizes, "<i8")
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
        score = np.zeros(sizes.size)
        for low, keys in window_keys(body, sizes, order):
            score += np.bincount(doc[low:low + keys.size], table[keys], sizes.size)
        place, keys = word_keys(body)
        owner, n = np.searchsorted(ends, place, side="right"), table[keys]
        base = np.bincount(owner, np.log10((n + 0.5) / (total + 0.5 * (distinct + 1))), sizes.size)
        count = lambda x: pa.array(np.bincount(x, minlength=sizes.size).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(~np.frombuffer(learned, bool)), count(owner), count(owner[n > 0]),
             pa.array(np.full(sizes.size, total, np.int64)), pa.array(base), pa.array(score)], names=names)

    return sorted_.mapInArrow(lean(run), T.StructType([T.StructField(x, k) for x, k in zip(names, kinds, strict=True)]))
