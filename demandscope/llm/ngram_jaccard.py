"""N-gram Jaccard join with Bayesian candidate pruning.

Documents become sets of five-word shingles, and sets become MinHash values. Sets that agree on the values of a band
are candidates (32 bands of 4 values: a pair at the threshold is missed with a probability below 1e-7). The values of
a candidate pair are then compared in steps: as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance, the pair is dropped. The rest is verified exactly on the shingles.

Candidates meet in blocks. A band's bucket is cut into chunks of bounded size, every pair of chunks is one task group,
and a group returns its verified links as counts and a spanning forest, so a large bucket makes neither a large task
nor a row per pair. A pair that shares several buckets is settled in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship
from demandscope.llm.words import combine, mix, slices, windows, words
from demandscope.operators.graph import components
from demandscope.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-7  # a pair is dropped when reaching the threshold is less likely than this
STEP = 16  # values compared before each decision
CHUNK = 256  # members of a bucket that go into one chunk, about
COLUMNS = 4096  # shingles that the exact verification counts at a time

_RANDOM = np.random.default_rng(20_011)
_FACTORS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending within each row, and the rows' bounds.

    A text of fewer words, but one at least, is one shingle: all its words.
    """
    w = words(column)
    first, shingle = windows(w, k)
    row = w.doc[first]
    counts = np.bincount(w.doc, minlength=len(column))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if short.size:
        starts = np.cumsum(counts) - counts
        own = np.array([combine(*(w.hash[starts[r] + i:starts[r] + i + 1] for i in range(counts[r])))[0] for r in short],
                       dtype=np.uint64)
        row, shingle = np.concatenate([row, short]), np.concatenate([shingle, mix(own)])
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    keep = np.ones(row.size, dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[keep], np.searchsorted(row[keep], np.arange(len(column) + 1))


def min_hashes(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of values per set; empty sets have the greatest value everywhere."""
    out = np.full((bounds.size - 1, VALUES), np.iinfo(np.uint32).max, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if full.size:
        for i in range(VALUES):
            value = ((shingles * _FACTORS[i] + _TERMS[i]) >> np.uint64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(value, bounds[full])
    return out


def set_ids(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits by which equal sets are known."""
    low, high = (np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(seed)))]) for seed in (1, 2))
    sums = np.stack([low[bounds[1:]] - low[bounds[:-1]], high[bounds[1:]] - high[bounds[:-1]]], axis=1)
    return [x.tobytes() for x in sums]


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Entry n: the fewest equal values among n with which a pair stays.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), so the probability of reaching the
    threshold is that of at most m successes in n + 1 trials.
    """
    table = []
    for n in range(VALUES + 1):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append(m)
    return tuple(table)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_id, n_shingles, values of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                shingles, bounds = shingle_sets(part.column(2))
                values = [x.tobytes() for x in min_hashes(shingles, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(set_ids(shingles, bounds), pa.binary()),
                     pa.array(np.diff(bounds).astype(np.int64)), pa.array(values, pa.binary())],
                    names=["doc_id", "text_hash", "set_id", "n_shingles", "values"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, T.StructType([
        docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("set_id", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("values", T.BinaryType())]))


def band_keys(values: np.ndarray) -> np.ndarray:
    """Sets x bands: a hash of each band's values over the band's number in the last bits; never 0."""
    wide = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
    value = combine(*(wide[:, :, i] for i in range(ROWS))) * np.uint64(2 * BANDS)
    return (value | np.uint64(BANDS) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def bands(sets: DataFrame) -> DataFrame:
    """set_id, key of every band of every set that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS))), pa.array(keys.ravel())],
                names=["set_id", "key"])

    return sets.where("n_shingles > 0").select("set_id", "values").mapInArrow(run, "set_id binary, key long")


def members(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """set_id, meets (key, chunks): the buckets in which a set has candidates.

    The keys are shuffled once, and only those of buckets with two members go on. Of several buckets with the very same
    members only one is kept.
    """
    bucket = Window.partitionBy("key")
    shared = stage(bands(sets).select(
        "key", "set_id", F.count("*").over(bucket).alias("n"), F.bit_xor(F.xxhash64("set_id")).over(bucket).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(7), "set_id")).over(bucket).alias("b")).where("n > 1"), "jaccard-buckets")
    kept = shared.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    return shared.select("key", "set_id").join(kept, "key").groupBy("set_id").agg(
        F.collect_list(F.struct("key", "chunks")).alias("meets"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``; shingles of one set alone are left out."""
    joined = np.concatenate([*a, *b])
    _, place, times = np.unique(joined, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(times.size, -1, dtype=np.int64)
    column[shared] = np.arange(shared.size)
    column = column[place]
    row = np.repeat(np.arange(len(a) + len(b)), [x.size for x in (*a, *b)])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for low in range(0, shared.size, COLUMNS):
        at, to = np.searchsorted(column, [low, low + COLUMNS])
        hold = np.zeros((len(a) + len(b), min(COLUMNS, shared.size - low)), dtype=np.float32)
        hold[row[at:to], column[at:to] - low] = 1
        out += hold[:len(a)] @ hold[len(a):].T
    return out.astype(np.int64)


def links_of(own: list[np.ndarray], other: list[np.ndarray], own_values: np.ndarray, other_values: np.ndarray,
             open_pairs: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of ``own`` x ``other`` are links: pruned by MinHash values in steps, then verified exactly."""
    least = least_matches(threshold, tolerance)
    i, j = np.nonzero(open_pairs)
    equal = np.zeros(i.size, dtype=np.int64)
    for at in range(0, VALUES, STEP):
        equal += np.concatenate([
            (own_values[i[s:s + 65536], at:at + STEP] == other_values[j[s:s + 65536], at:at + STEP]).sum(axis=1)
            for s in range(0, i.size, 65536)] or [np.zeros(0, np.int64)])
        stay = equal >= least[at + STEP]
        i, j, equal = i[stay], j[stay], equal[stay]
    links = np.zeros(open_pairs.shape, dtype=bool)
    if i.size:
        rows, columns = np.unique(i), np.unique(j)
        both = overlaps([own[r] for r in rows], [other[c] for c in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
        size = np.array([x.size for x in own])[i] + np.array([x.size for x in other])[j] - both
        links[i, j] = both >= threshold * size - 1e-9
    return links


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of ``n`` nodes is linked to, directly or not."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def settle(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """The links of one pair of chunks: for every linked set its number of links here, and a set it is linked with."""
    key, left, right = (table.column(c)[0].as_py() for c in ("key", "left", "right"))
    ids = table.column("set_id").to_pylist()
    order = sorted({x: i for i, x in enumerate(ids)}.items())  # a set once, should its text be there twice
    table, ids = table.take(pa.array([i for _, i in order])), [x for x, _ in order]
    shingles, bounds = shingle_sets(table.column("text").combine_chunks())
    sets = [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)
    keys = np.zeros((len(ids), BANDS), dtype=np.int64)
    for row, meets in enumerate(table.column("meets").to_pylist()):
        keys[row, np.array(meets) % BANDS] = meets
    chunk = table.column("chunk").to_numpy()
    a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
    open_pairs = np.ones((a.size, b.size), dtype=bool) if left != right else np.triu(np.ones((a.size, a.size), dtype=bool), 1)
    for earlier in range(key % BANDS):  # these pairs are settled in an earlier bucket
        open_pairs &= ~((keys[a, earlier][:, None] == keys[b, earlier][None, :]) & (keys[a, earlier] != 0)[:, None])
    links = links_of([sets[x] for x in a], [sets[x] for x in b], values[a], values[b], open_pairs, threshold, tolerance)
    i, j = np.nonzero(links)
    i, j = a[i], b[j]
    counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = forest(len(ids), i, j)
    linked = np.flatnonzero(counts)
    return pa.table({
        "set_id": pa.array([ids[x] for x in linked], pa.binary()), "n": pa.array(counts[linked], pa.int64()),
        "root": pa.array([ids[root[x]] for x in linked], pa.binary())})


def jaccard_links(rows: DataFrame, sketched: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                  chunk: int = CHUNK) -> DataFrame:
    """set_id, n (links), root of the linked sets, one row per pair of chunks in which a set has links."""
    best = sketched.groupBy("set_id").agg(
        F.max(F.struct("doc_id", "text_hash", "n_shingles", "values")).alias("s")).select("set_id", "s.*")
    sets = stage(best, "jaccard-sets")
    wanted = members(sets, chunk).join(sets, "set_id").select(
        "set_id", "meets", "values", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["text_hash"] == wanted["hash"]))
    blocks = (
        texts.select("set_id", "meets", "values", "text", F.explode("meets").alias("m"))
        .withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("m.chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m.chunks") - 1)))
        .select("set_id", F.col("meets.key").alias("meets"), "values", "text", "m.key", "chunk",
                F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right")))
    return blocks.groupBy("key", "left", "right").applyInArrow(
        lambda table: settle(table, threshold, tolerance), "set_id binary, n long, root binary")


def _classes(docs: DataFrame, threshold: float, tolerance: float, chunk: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_shingles, kept of each row."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    sketched = stage(sketches(rows), "jaccard-sketches")
    found = stage(jaccard_links(rows, sketched, threshold, tolerance, chunk), "jaccard-links")
    roots = components(found.select(F.lit("").alias("storefront"), F.col("set_id").alias("a"), F.col("root").alias("b"))).select(
        F.col("term").alias("set_id"), "root")
    sets = (
        sketched.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least"))
        .join(found.groupBy("set_id").agg(F.sum("n").alias("n_links")), "set_id", "left")
        .join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    sets = stage(sets, "jaccard-classes")
    classes = sets.groupBy("root").agg(F.min("least").alias("first"))
    named = sets.join(classes, "root").select("set_id", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sketched.select("doc_id", "text_hash", "set_id", "n_shingles").join(named, "set_id").select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "n_links", "n_shingles",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_shingles, kept.

    Texts with equal sets of shingles are copies, also empty ones; sets of a similarity of at least ``threshold`` are
    linked; a class is all that links and copies connect, named after its least id. ``n_links`` counts the other sets
    that the document's set is linked with. ``kept`` marks the document with the least id, of several texts under that
    id the one with the least hash; rows that repeat both are flagged alike. Null text is empty. A null id comes after
    all others, so only a class of null ids has a null class_id. No rows give no rows; other columns are not read.
    """
    return _classes(docs, threshold, tolerance, chunk, id_col, text_col).drop("text_hash")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_classes`` keeps: one document of each class."""
    kept = _classes(docs, threshold, tolerance, chunk, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"),
                       F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"))
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["text_hash"] == kept["hash"]), "left_semi").select("row.*")
