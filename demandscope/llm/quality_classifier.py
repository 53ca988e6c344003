"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text that the good dictionary compresses better than the bad one is like the good texts. Texts are compressed in
blocks, each with a fresh dictionary, so that a long text's own history does not take the dictionary's place. The
difference of both compressed sizes, taken per byte of text and per compressed byte, goes with the length and the share
that is left through a logistic curve fitted on labelled rows that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship
from demandscope.session import stage

DICTIONARY = 64 << 10
LEVEL = 3
SAMPLE = 2000  # labelled rows of each class at most: two thirds for the dictionary, the rest for the curve
BLOCK = 16 << 10  # bytes of a text that are compressed on their own
LONGEST = 64_000  # characters of a text that a dictionary is trained on; of longer ones four pieces, first to last
CUT = 0.3


def held_out(id_column):
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, list[int]]:
    """doc_id, quality, place in the class and text of the sampled rows, and the number of learnable labels of each class."""
    learn = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("quality").alias("quality"))
    counts = dict(learn.groupBy("quality").count().collect())
    chosen = None
    for label in (0, 1):
        own = learn.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.unionAll(own)
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    met = docs.select("doc_id").join(stage(chosen, "labelled"), "doc_id").distinct()
    placed = stage(met.withColumn("place", F.row_number().over(order) - 1), "labelled-places")  # at most 2 * most rows
    texts = docs.join(placed, "doc_id").groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text"))
    return stage(texts, "labelled-texts"), [counts.get(0, 0), counts.get(1, 0)]


def training_texts(sample: DataFrame) -> dict[int, list[bytes]]:
    """By label, what the dictionaries are trained on: two thirds of the sampled texts."""
    size, piece = F.length("text"), LONGEST // 4
    pieces = F.array(*(F.col("text").substr((1 + F.floor((size - piece) * i / 3)).cast("int"), F.lit(piece)) for i in range(4)))
    rows = sample.where("place % 3 > 0").orderBy("quality", "place").select(
        "quality", F.when(size <= LONGEST, F.col("text")).otherwise(F.array_join(pieces, "\n")).alias("text")).collect()
    return {q: [t.encode() for label, t in rows if label == q] for q in (0, 1)}


def curve_rows(sample: DataFrame, good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the other third, whole texts of any length; only the features go to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2).to_pylist(), good, bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(4))],
                names=["quality", "place", "a", "b", "c", "d"])

    rest = sample.where("place % 3 = 0").select(
        F.col("quality").cast("int"), "place", F.col("text").cast("binary").alias("text"))
    rows = sorted(rest.mapInArrow(run, "quality int, place int, a double, b double, c double, d double").collect())
    return np.array([r[2:] for r in rows], dtype=float).reshape(-1, 4), np.array([r[0] for r in rows], dtype=float)


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the texts' own last bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: the difference per byte and per compressed byte, log of the share left, log of the length."""
    tools = [compressor(content) for content in (good, bad)]
    blocks = [[t[i:i + BLOCK] for i in range(0, max(1, len(t)), BLOCK)] for t in texts]
    sizes = np.array([[sum(len(tool.compress(b)) for b in own) for tool in tools] for own in blocks], dtype=float).reshape(-1, 2)
    length = np.array([max(1, len(t)) for t in texts], dtype=float)
    saved = sizes[:, 1] - sizes[:, 0]
    return np.stack([saved / length, saved / sizes.sum(axis=1), np.log(sizes[:, 0] / length), np.log(length)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the features, then the offset, of a logistic curve, by Newton's method with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.array([1.0] * x.shape[1] + [0.01])
    b = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = b[:-1] / scale
    return np.append(slopes, b[-1] - slopes @ mean)


class Model:
    """Two dictionaries and a curve; without texts of both classes, the share of good labels for everyone."""

    def __init__(self, sample: DataFrame, counts: list[int]):
        self.good = self.bad = b""
        total = sum(counts)
        self.curve = np.array([0.0] * 4 + [float(np.log((counts[1] + 1) / (counts[0] + 1)))])
        found = dict(sample.groupBy("quality").count().collect())
        if min(found.get(0, 0), found.get(1, 0)) < 4:
            return
        parts = training_texts(sample)
        self.good, self.bad = dictionary(parts[1]), dictionary(parts[0])
        x, y = curve_rows(sample, self.good, self.bad)
        share = [counts[q] / max(1, int((y == q).sum())) for q in (0, 1)]  # classes are sampled alike, so weigh them back
        self.curve = fit_curve(x, y, np.where(y == 1, share[1], share[0]) * len(y) / max(1, total))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = features(texts, self.good, self.bad) if self.good else np.zeros((len(texts), 4))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -50, 50)))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text"
                   ) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Only ids choose what is learned from; the score sees the text alone. Null texts are empty and are scored like any other
    text, a null id is in no fold. Rows of equal text score alike. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    model = Model(*labelled_sample(rows, labels))
    folded = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return folded.mapInArrow(run, T.StructType([
        rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType())]))
