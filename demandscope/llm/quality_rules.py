"""Quality rules: base counts, and a log-likelihood ratio between trusted-target and raw-corpus multinomials.

The hashed one- and two-word grams of every document are counted over the whole corpus; those of all trusted documents
make the target. A document's score is the mean log ratio of its grams, so its length does not matter, and a fixed
threshold decides. A gram's ratio is drawn to 1 by prior target counts: a least number, so that rare grams of a small
corpus condemn nobody, and beyond it a share of the target, so that a larger corpus of the same make scores alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, lean, ship
from demandscope.llm.words import combine, raw_bytes, slices, windows, words
from demandscope.session import stage

BITS = 16  # grams fall into 2**BITS buckets; a fixed table, whatever the corpus
PRIOR = 20.0
PRIOR_SHARE = PRIOR / 2_750_000  # of the target's grams; the target of sf0.1 has so many, there both priors are equal
THRESHOLD = -0.05
LEAST_WORDS = 50
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents (labels.quality is 1)."""
    return stage(labels.where(F.col("quality") == 1).select("doc_id").where("doc_id IS NOT NULL").distinct(), "trusted")


def grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every one- and two-word gram."""
    w = words(column)
    first, pairs = windows(w, 2)
    shift = np.uint64(64 - bits)
    return (np.concatenate([w.doc, w.doc[first]]),
            np.concatenate([w.hash >> shift, pairs >> shift]).astype(np.int64))


def gram_counts(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents, and over the trusted ones: two arrays of 2**bits numbers."""
    ship(docs.sparkSession)
    # hashed on either side at every size: the texts are then never sorted
    flags = trusted.select(F.col("doc_id"), F.lit(True).alias("trusted")).hint("shuffle_hash")
    marked = docs.join(flags, "doc_id", "left").select(
        "text", F.col("trusted").isNotNull().alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                row, bucket = grams(part.column(0), bits)
                raw += np.bincount(bucket, minlength=1 << bits)
                inside = part.column(1).to_numpy(zero_copy_only=False)[row]
                target += np.bincount(bucket[inside], minlength=1 << bits)
        own = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(raw[own]), pa.array(target[own])],
                                         names=["bucket", "raw", "target"])

    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    counted = marked.mapInArrow(lean(run), "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for bucket, r, t in counted.toLocalIterator():  # at most 2**bits rows
        raw[bucket], target[bucket] = r, t
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float | None = None) -> np.ndarray:
    """Log of target count over the count expected from the raw corpus; 0 where there is no target.

    Without ``prior`` it is PRIOR, or PRIOR_SHARE of the target where that is more.
    """
    prior = max(PRIOR, PRIOR_SHARE * target.sum()) if prior is None else prior
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + prior) / (expected + prior)) if target.sum() else np.zeros(raw.size)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(column)
    w = words(column)
    _, offsets = raw_bytes(column)
    at = lambda places: np.bincount(np.searchsorted(offsets, places, side="right") - 1, minlength=n)[:n]
    size = np.bincount(w.doc, weights=w.end - w.start, minlength=n).astype(np.int64)
    first, triple = windows(w, 3)
    key = combine(triple, w.doc[first].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(key.size, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    repeated = np.zeros(w.hash.size, dtype=bool)
    for i in range(3):
        repeated[first[again] + i] = True
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            own = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[i] = len(own) - len(set(own))
    return {"n_words": np.bincount(w.doc, minlength=n), "word_chars": size - at(np.flatnonzero((w.data & 0xC0) == 0x80)),
            "n_symbols": at(np.flatnonzero(_SYMBOL[w.data])), "n_dup_lines": lines,
            "n_repeat_words": np.bincount(w.doc[repeated], minlength=n)}


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | None = None,
                  bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
                  ) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, llr.

    A document stays if it has 50 words or more, at most half of them in repeated three-word windows, and a score of at
    least ``threshold``. Null text is empty and fails; without trusted documents every score is 0. Repeated rows count
    as often as they occur. Equal windows and lines are found by 64-bit hash and by value. ``carry`` names columns of
    ``docs`` that take the place of doc_id, as the struct ``row``. No rows give no rows.
    """
    ship(docs.sparkSession)
    table = log_ratios(*gram_counts(id_and_text(docs, id_col, text_col), trusted_ids(labels), bits), prior)
    if carry:
        rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    else:
        rows = id_and_text(docs, id_col, text_col)
    lead = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counts = base_counts(part.column(1))
                row, bucket = grams(part.column(1), bits)
                total = np.bincount(row, weights=table[bucket], minlength=part.num_rows)
                llr = total / np.maximum(1, np.bincount(row, minlength=part.num_rows))
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(counts[c], pa.int64()) for c in COLUMNS), pa.array(failed),
                     pa.array(~failed & (llr >= threshold)), pa.array(llr)],
                    names=[lead, *COLUMNS, "base_failed", "kept", "llr"])

    return rows.mapInArrow(lean(run), T.StructType([
        rows.schema[lead], *(T.StructField(c, T.LongType()) for c in COLUMNS), T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()), T.StructField("llr", T.DoubleType())]))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    return quality_rules(docs, labels, threshold, carry=docs.columns).where("kept").select("row.*")
