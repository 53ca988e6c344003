"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

A line that may differ by k edits is split into k + 1 segments; one of them survives any k edits. So a line looks up,
for each length that a partner may have, the substrings of itself at the few places where a segment of such a line can
lie. Lines that share a look-up key are candidates, and a banded bit-parallel edit distance decides. Keys, not lines,
are shuffled for that; lines follow only where a key has two of them. A key's lines meet in blocks of bounded size, and
a block returns counts and a spanning forest, so a common segment makes neither a large task nor a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship
from demandscope.llm.ngram_jaccard import forest
from demandscope.llm.words import mix, slices
from demandscope.operators.graph import components
from demandscope.session import stage

LENGTHS = ((20, 1), (60, 2))  # from so many characters on, a line may differ by so many edits; shorter ones by none
MOST_EDITS = 2
CHUNK = 256  # lines of a key that go into one chunk, about
FLUSH = 8192  # pairs that are verified at a time
BLANK = " \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def edits_allowed(length: np.ndarray | int) -> np.ndarray | int:
    """By the length of the shorter line of a pair."""
    return sum((length >= least) * 1 for least, _ in LENGTHS)


def lines_of(text: str) -> list[tuple[int, str]]:
    """Number and text of the lines that are not blank."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(BLANK)]


def line_id(line: str) -> int:
    return int.from_bytes(blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def segment(length: np.ndarray, edits: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` (from 0) of lines of this length: the last ones are longer by one."""
    size, longer = np.divmod(length, edits + 1)
    late = np.maximum(0, i - (edits + 1 - longer))
    return i * size + late, size + (i >= edits + 1 - longer)


def lookup_keys(lines: list[str]) -> np.ndarray:
    """Lines x places: the keys of each line, ascending, 0 where there is none."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    length = np.array([len(x) for x in lines], dtype=np.int64)
    begin = np.cumsum(length) - length
    n = codes.size + 1
    power, inverse = (np.multiply.accumulate(np.array([1] + [b] * (n - 1), dtype=np.uint64)) for b in (_BASE, _INVERSE))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[:-1])])
    columns = []
    for less in range(MOST_EDITS + 1):  # how much shorter the partner is
        partner = length - less
        edits = edits_allowed(partner)
        for i in range(MOST_EDITS + 1):
            start, size = segment(partner, edits, i)
            low = np.maximum(-i, less - (edits - i))
            high = np.minimum(i, less + (edits - i))
            for shift in range(-i, i + 1):
                at = start + shift
                good = (partner > 0) & (less <= edits) & (i <= edits) & (low <= shift) & (shift <= high)
                good &= (at >= 0) & (at + size <= length)
                if good.any():
                    a, b = np.where(good, begin + at, 0), np.where(good, begin + at + size, 0)
                    value = (prefix[b] - prefix[a]) * inverse[a]
                    key = mix(value ^ mix((partner * 8 + i).astype(np.uint64))) | np.uint64(1)
                    columns.append(np.where(good, key, np.uint64(0)).view(np.int64))
    keys = np.sort(np.stack(columns, axis=1), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = 0
    return keys


def within(pairs: list[tuple[str, str]], allowed: np.ndarray) -> np.ndarray:
    """Which pairs are within ``allowed`` edits: Hyyro's bit-parallel distance in a diagonal band, many pairs at once.

    Bit b of a word stands for row j - k + b of column j, k being the greatest number of edits; rows outside the band
    are farther than k.
    """
    k = MOST_EDITS
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    m, n = (np.array([len(x) for x in side]) for side in (a, b))
    if len(pairs) == 0:
        return np.zeros(0, dtype=bool)
    rows, columns = int(m.max()), int(n.max())
    s = np.zeros((rows + 2 * k + 2, len(pairs)), dtype=np.uint32)  # row i of the first line at i + k; 0 matches nothing
    t = np.full((columns, len(pairs)), 0xFFFFFFFF, dtype=np.uint32)
    for side, table, off in ((a, s, k), (b, t, 0)):
        for p, line in enumerate(side):
            table[off:off + len(line), p] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s[k:k + rows] += (np.arange(rows)[:, None] < m)  # so that the character 0 differs from the padding
    t[t != 0xFFFFFFFF] += np.uint32(1)
    one, low = np.uint64(1), 63 - 2 * k
    vp = np.full(len(pairs), np.uint64(((1 << 64) - 1) ^ ((1 << (low + k)) - 1)))
    vn = np.zeros(len(pairs), dtype=np.uint64)
    distance = np.full(len(pairs), k, dtype=np.int64)
    for j in range(1, columns + 1):
        match = np.zeros(len(pairs), dtype=np.uint64)
        for bit in range(2 * k + 1):  # row j - k + bit lies at j - 1 + bit
            match |= (s[j - 1 + bit] == t[j - 1]).astype(np.uint64) << np.uint64(low + bit)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        place = np.clip(low + m - j + k, 0, 63).astype(np.uint64)  # of the last row
        across = ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64)
        distance += np.where(j <= m - k, 1 - (d0 >> np.uint64(63)).astype(np.int64), np.where(j <= n, across, 0))
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return distance <= allowed


def occurrences(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, line_no, line_id of every line, and one row without a line for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                rows, numbers, ids = [], [], []
                for row, text in enumerate(part.column(3).to_pylist()):
                    own = lines_of(text)
                    rows += [row] * (len(own) + 1)
                    numbers += [None, *(i for i, _ in own)]
                    ids += [None, *(line_id(x) for _, x in own)]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in range(3)), pa.array(numbers, pa.int64()), pa.array(ids, pa.int64())],
                    names=["row_id", "doc_id", "text_hash", "line_no", "line_id"])

    return docs.select("row_id", "doc_id", "text_hash", "text").mapInArrow(run, T.StructType([
        T.StructField("row_id", T.LongType()), docs.schema["doc_id"], T.StructField("text_hash", T.LongType()),
        T.StructField("line_no", T.LongType()), T.StructField("line_id", T.LongType())]))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """key, line_id for every look-up key; lines that a slice of a batch repeats are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                lines = list({x: None for text in part.column(0).to_pylist() for _, x in lines_of(text) if len(x) >= LENGTHS[0][0]})
                if lines:
                    keys = lookup_keys(lines)
                    row, place = np.nonzero(keys)
                    ids = np.array([line_id(x) for x in lines], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row, place]), pa.array(ids[row])], names=["key", "line_id"])

    return docs.select("text").mapInArrow(run, "key long, line_id long")


def members(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """line_id, meets (key, chunks): the keys under which a line has candidates; of keys with the same lines, one.

    The keys are shuffled once, and only those of two different lines go on. A line that several slices emit is counted
    as often under each of its keys, so equal sums still mean equal lines.
    """
    key = Window.partitionBy("key")
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "line_id").bitwiseAND(F.lit(0x7FFFFFFF))).over(key)
    shared = stage(keyed_lines(docs).select(
        "key", "line_id", F.count("*").over(key).alias("n"), F.min("line_id").over(key).alias("low"),
        F.max("line_id").over(key).alias("high"), part(1).alias("a"), part(2).alias("b")).where("low != high"), "line-keys")
    kept = shared.groupBy("n", "low", "high", "a", "b").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    return shared.select("key", "line_id").join(kept, "key").groupBy("line_id").agg(
        F.collect_set(F.struct("key", "chunks")).alias("meets"))


class _Settling:
    """Pairs of lines that wait for their distance; links come out as counts and a forest."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, str]] = []
        self.ids: list[tuple[int, int]] = []

    def add(self, key: int, own: dict, other: dict | None) -> Iterator[pa.RecordBatch]:
        """All pairs of a block that have no smaller key in common and may be near enough."""
        for (x, (a, keys)), (y, (b, others)) in combinations(own.items(), 2) if other is None else product(own.items(), other.items()):
            shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
            if len(longer) - len(shorter) <= edits_allowed(len(shorter)) and min(keys & others) == key:
                self.lines.append((shorter, longer))
                self.ids.append((x, y))
                if len(self.ids) >= FLUSH:
                    yield self.flush()

    def flush(self) -> pa.RecordBatch:
        order = np.argsort([len(b) for _, b in self.lines], kind="stable")
        linked = []
        for at in range(0, order.size, 2048):  # pairs of like length share the work
            part = order[at:at + 2048]
            own = [self.lines[i] for i in part]
            good = within(own, edits_allowed(np.array([len(a) for a, _ in own])))
            linked += [self.ids[i] for i in part[good]]
        self.lines, self.ids = [], []
        nodes, place = np.unique(np.array(linked, dtype=np.int64).reshape(-1, 2), return_inverse=True)
        i, j = place.reshape(-1, 2).T
        counts = np.bincount(i, minlength=nodes.size) + np.bincount(j, minlength=nodes.size)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(counts.astype(np.int64)), pa.array(nodes[forest(nodes.size, i, j)])],
            names=["line_id", "n", "root"])


def line_links(docs: DataFrame, lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """line_id, n (links), root of the lines that have near lines."""
    first = lines.where("line_id IS NOT NULL").groupBy("line_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "line_no")).alias("first"))
    wanted = members(docs, chunk).join(first, "line_id").groupBy(
        F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")).agg(
        F.collect_list(F.struct("line_id", "meets", "first.line_no")).alias("own"))  # at most one per line of the text
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["text_hash"] == wanted["hash"]))
    blocks = (
        texts.select(F.split("text", "\n").alias("lines"), F.explode("own").alias("own"))
        .select("own.line_id", "own.meets", F.get("lines", F.col("own.line_no").cast("int")).alias("line"))
        .select("*", F.explode("meets").alias("m"))
        .withColumn("chunk", F.pmod(F.xxhash64("line_id"), F.col("m.chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m.chunks") - 1)))
        .select("m.key", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk",
                "line_id", "line", F.col("meets.key").alias("keys")))
    block = ["key", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settling, now, sides = _Settling(), None, ({}, {})
        for batch in batches:
            for key, left, right, chunk_no, line, text, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, left, right) != now:
                    if now:
                        yield from settling.add(now[0], sides[0], None if now[1] == now[2] else sides[1])
                    now, sides = (key, left, right), ({}, {})
                sides[chunk_no != left][line] = (text, frozenset(keys))
        if now:
            yield from settling.add(now[0], sides[0], None if now[1] == now[2] else sides[1])
        if settling.ids:
            yield settling.flush()

    return blocks.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "line_id long, n long, root long")


def line_classes(docs: DataFrame, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, line_no, line_id, first_doc, first_line, n_links, dropped, near of every line that is not blank.

    Equal lines are copies; lines within the edits allowed at their length are linked; a class is all that links and
    copies connect. Its first line, by doc_id and line number, stays, the others are dropped; ``near`` says that the
    first line reads differently. Each document also has a row whose line_no is null.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()).withColumn(
        "text_hash", F.xxhash64("text"))
    lines = stage(occurrences(rows), "line-occurrences")
    found = stage(line_links(rows, lines, chunk), "line-links")
    roots = components(found.select(F.lit("").alias("storefront"), F.col("line_id").alias("a"), F.col("root").alias("b"))).select(
        F.col("term").alias("line_id"), "root")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_id", "line_no", "line_id")
    own = (
        lines.where("line_id IS NOT NULL").groupBy("line_id").agg(F.min(place).alias("least"))
        .join(found.groupBy("line_id").agg(F.sum("n").alias("n_links")), "line_id", "left")
        .join(roots, "line_id", "left").withColumn("root", F.coalesce("root", "line_id")))
    own = stage(own, "line-classes")
    first = own.groupBy("root").agg(F.min("least").alias("first"))
    named = own.join(first, "root").select("line_id", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    same = (F.col("row_id") == F.col("first.row_id")) & (F.col("line_no") == F.col("first.line_no"))
    return lines.join(named, "line_id", "left").select(
        "row_id", "doc_id", "line_no", "line_id", F.col("first.doc_id").alias("first_doc"),
        F.col("first.line_no").alias("first_line"), "n_links", F.coalesce(~same, F.lit(False)).alias("dropped"),
        F.coalesce(~same & (F.col("line_id") != F.col("first.line_id")), F.lit(False)).alias("near"))


def line_dedup(docs: DataFrame, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, n_near, n_links, dropped (line numbers, comma-joined).

    ``n_links`` adds up, over the document's lines, how many other lines each is linked with. Null and blank texts have
    no lines; a null id comes after all others; repeated rows repeat each other's lines. No rows give no rows; other
    columns are not read.
    """
    return line_classes(docs, chunk, id_col, text_col).groupBy("row_id", "doc_id").agg(
        F.count("line_no").alias("n_lines"), F.sum(F.col("dropped").cast("long")).alias("n_dropped"),
        F.sum(F.col("near").cast("long")).alias("n_near"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("dropped"), F.col("line_no")))), ",").alias("dropped")).drop("row_id")
