"""Packing: concatenate and cut, by two-pass prefix sums over the token totals of runs of documents.

Pass 1 tokenizes every partition where it lies and writes the ids with their offsets inside the run. The totals of the
runs, one row each, give global offsets. Pass 2 cuts fixed windows; a document that crosses a window's edge becomes
boundary records on both sides. Nothing is shuffled but the totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship, with_offsets
from demandscope.llm.tokenize import encoder, resolve
from demandscope.session import stage

WINDOW = 1024


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str,
              place: tuple[Column, Column] | None) -> DataFrame:
    """run_file, run_row, local, doc_id, n, ids: a run is a stretch of documents that lie one after the other."""
    place = place or (F.lit(""), F.lit(None).cast("long"))
    rows = id_and_text(docs, id_col, text_col, place[0].alias("file"), place[1].cast("long").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(resolve(tokenizer))
        end = encode.to_bytes([end_id])
        width = encode.dtype.itemsize
        task = TaskContext.get().partitionId()
        key, last_row, local = None, None, 0
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, file, row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                follows = key is not None and (row is None or (file == key[0] and row == last_row + 1))
                if not follows:
                    key, local = (file, task if row is None else row), 0
                last_row = row
                ids = encode.encode(text) + end
                n = len(ids) // width
                for column, value in zip(columns, (*key, local, n, ids), strict=True):
                    column.append(value)
                local += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 batch.column(0), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())],
                names=["run_file", "run_row", "local", "doc_id", "n", "ids"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("run_file", T.StringType()), T.StructField("run_row", T.LongType()),
        T.StructField("local", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType),
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]))


def cut(start: int, n: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of each piece of ``n`` ids that begin at ``start``."""
    pieces, done = [], 0
    while done < n:
        sequence, offset = divmod(start + done, window)
        length = min(n - done, window - offset)
        pieces.append((done, length, sequence, offset))
        done += length
    return pieces


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", place: tuple[Column, Column] | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    All sequences but the last are full. ``place`` (file name, row in the file) fixes the order of the documents;
    without it they are taken as the scan deals them. Null and empty texts are just the end id. Ids may be null or
    repeat: every row is a document of its own. No rows give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    ids = stage(tokenized(docs, tokenizer, end_id, id_col, text_col, place), "pack-ids")
    offsets = with_offsets(ids, ["run_file", "run_row"], "n", "pack-offsets")
    placed = ids.join(offsets, ["run_file", "run_row"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("begin"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(resolve(tokenizer)).dtype
        for batch in batches:
            rows, pieces, blobs = [], [], []
            for i, (begin, n, blob) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                wide = np.frombuffer(blob, dtype).astype("<u4").tobytes()
                for piece in cut(begin, n, window):
                    part = wide[4 * piece[0]:4 * (piece[0] + piece[1])]
                    rows.append(i)
                    pieces.append((*piece, zlib.crc32(part), n))
                    if with_ids:
                        blobs.append(part)
            start, length, sequence, offset, crc, total = (
                pa.array(x, pa.int64()) for x in (zip(*pieces, strict=True) if pieces else [[]] * 6))
            more = [pa.array(blobs, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), start, length, crc, total, sequence, offset, *more],
                names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = T.StructType([
        T.StructField(x, placed.schema["doc_id"].dataType if x == "doc_id" else T.BinaryType() if x == "ids"
                      else T.LongType()) for x in names])
    return placed.mapInArrow(run, schema)
