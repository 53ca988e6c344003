"""Exact dedup: an extendible-hash index on shared files, owned by tasks in key ranges.

The directory starts as one bucket. A bucket with more than ``capacity`` keys splits on its next hash bit; when the
bucket is as deep as the directory, the directory doubles first. Documents are folded by bytes inside each task, go
to the owner of their bucket once, and are written to the index in (bucket, hash) order. Texts that share a hash form
a chain in which bytes, not hashes, decide what is equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text
from demandscope.session import staging_root

CAPACITY = 1024  # keys of a bucket
MOST_BUCKETS = 1 << 16  # beyond this many buckets they hold more keys, so the directory has a size bound
FOLD_BYTES = 32 << 20  # text that a task holds to fold copies before the shuffle


def slot_of(key: Column, depth: int) -> Column:
    """The directory slot of a hash: its ``depth`` leading bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(cells: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """Global depth, and the local depth of each slot, from the key counts of the finest cells.

    ``cells`` has 2**k counts. A bucket that is overfull at depth k stays whole: its keys chain in one bucket.
    """
    finest = int(cells.size).bit_length() - 1
    sums = [cells]  # sums[i]: counts at depth finest - i
    while sums[-1].size > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    depth, local = 0, np.zeros(1, dtype=np.int64)
    while depth < finest:
        overfull = (sums[finest - depth] > capacity) & (local == depth)
        if not overfull.any():
            break
        local, depth = np.repeat(local, 2), depth + 1  # the directory doubles
        local[np.repeat(overfull, 2)] = depth  # and the overfull buckets split
    return depth, local


def directory(keyed: DataFrame, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """Count distinct keys by cell on Spark; only the bounded table of cells comes to the driver."""
    keys = keyed.select("key").distinct()
    rows = keyed.count()  # an upper bound of the keys, answered from file footers where possible
    finest = max(4, min(rows // max(1, min(capacity, CAPACITY)), MOST_BUCKETS).bit_length() + 2)
    capacity = max(capacity, rows // MOST_BUCKETS)
    cells = np.zeros(1 << finest, dtype=np.int64)
    for slot, n in keys.groupBy(slot_of(F.col("key"), finest).alias("slot")).count().collect():
        cells[slot] = n
    return build_directory(cells, capacity)


def bucket_of(keys: np.ndarray, depth: int, local: np.ndarray) -> np.ndarray:
    """The first slot of each key's bucket, so that a bucket is a range of hashes."""
    slots = (keys.astype(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(keys.size, np.int64)
    below = depth - local[slots]
    return (slots >> below) << below


def fold(table: pa.Table) -> pa.Table:
    """One row per text: how many rows have these bytes, and their greatest id."""
    return table.group_by(["key", "text"]).aggregate([("doc_id", "max"), ("n", "sum")]).rename_columns(
        ["key", "text", "doc_id", "n"])


def folded(keyed: DataFrame, depth: int, local: np.ndarray) -> DataFrame:
    """Copies inside a task become one row before anything is shuffled; each row gets its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            table = fold(pa.concat_tables(held))
            bucket = bucket_of(table["key"].to_numpy(), depth, local)
            yield from table.append_column("bucket", pa.array(bucket)).to_batches(max_chunksize=2000)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(fold(table.append_column("n", pa.array(np.ones(batch.num_rows, dtype=np.int64)))))
            size += held[-1].nbytes
            if size > FOLD_BYTES:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("doc_id", keyed.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("bucket", T.LongType())])
    return keyed.mapInArrow(run, schema)


def write_index(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write the index files and read them back: bucket, key, chain, text, text_sha256, keep_id, group_size.

    ``chain`` numbers the different texts that share a hash. A rerun task meets the same rows, so losing an executor
    changes nothing.
    """
    keyed = id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    owned = folded(keyed, *directory(keyed, capacity)).repartition("bucket")
    chained = (
        owned.groupBy("bucket", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text"))))
    chained.select("bucket", "key", "chain", "text", F.sha2("text", 256).alias("text_sha256"), "keep_id",
                   "group_size").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _index_of(docs: DataFrame, capacity: int, id_col: str, text_col: str, index_path: str | None) -> DataFrame:
    path = index_path or f"{staging_root(docs.sparkSession)}/demandscope/exact-index-{uuid.uuid4().hex}"
    return write_index(docs, path, capacity, id_col, text_col).select("key", "text_sha256", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                index_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The greatest id of equal texts stays. Rows that repeat
    both the id and the text are flagged alike. A null id is never greatest; if all ids of a group are null, keep_id
    is null and all are kept. No rows give no rows. Other columns are not read, so their names do not matter.
    """
    index = _index_of(docs, capacity, id_col, text_col, index_path)
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(index, ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   index_path: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, one for each text: the one with the greatest id, of repeated rows any one."""
    kept = _index_of(docs, capacity, id_col, text_col, index_path).select(
        F.col("keep_id").alias("id"), F.col("key").alias("kept_key"), F.col("text_sha256").alias("kept_sha256"))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"),
                       F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
    same = ((rows["key"] == kept["kept_key"]) & (rows["text_sha256"] == kept["kept_sha256"])
            & rows["doc_id"].eqNullSafe(kept["id"]))
    one = Window.partitionBy("doc_id", "key", "text_sha256").orderBy("key")
    return rows.join(kept, same, "left_semi").withColumn("copy", F.row_number().over(one)).where("copy = 1").select("row.*")
