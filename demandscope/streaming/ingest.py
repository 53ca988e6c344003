"""Continuous ingest: file streams that end in the same tables as the batch jobs.

All streams run with ``availableNow`` by default, so a scheduler can start them as often as
needed; the checkpoint remembers what was read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from demandscope.sources import tables


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream the table ``name``, which is one file or a folder of part files.

    A streamed path must be a folder or a glob, so the name is written as a glob that only it matches.
    """
    return file_stream(spark, f"{folder}/{{{name}}}.parquet", schema, "*")


def append_stream(rows: DataFrame, path: str, checkpoint: str, *partition_by: str) -> StreamingQuery:
    """Land rows in an append-only table."""
    return (
        rows.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str],
                  partition_by: list[str]) -> StreamingQuery:
    """Keep the row with the greatest ``order`` per key; late rows correct the table, a replay changes nothing.

    Every micro-batch rewrites the partitions it touches from the version before it, so the merge reads only those.
    A null is a partition like any other. The merged partitions are first written whole beside the checkpoint, under
    the number of the batch. A batch that dies while it overwrites the table is run again with the same number, and then
    takes them from there: rows that the half-done overwrite has deleted are in it.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = f"{checkpoint}-upserts/batch-{batch_id}"
        if not tables.finished(spark, merged):
            batch = batch.persist()
            stored = batch.filter(F.lit(False))
            if tables.exists(spark, path):
                touched = batch.select(*[F.col(c).alias(f"_{c}") for c in partition_by]).distinct()
                same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_by))
                stored = spark.read.schema(batch.schema).parquet(path).join(touched, same, "left_semi").select(*batch.columns)
            tables.last_wins(stored, batch, key, order).write.mode("overwrite").parquet(merged)
            batch.unpersist()
        tables.overwrite_partitions(spark.read.schema(batch.schema).parquet(merged), path, *partition_by)
        tables.remove(spark, f"{checkpoint}-upserts/batch-{batch_id - 1}")  # its batch is committed

    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upsert_daily_metrics(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One reading per (item, storefront, day): the last one by time, however late it comes."""
    return upsert_stream(readings.withColumn("day", F.col("ts").cast("date")), path, checkpoint,
                         ["track_id", "storefront", "day"], ["ts", "reading_id"], ["day"])


POPULARITY_KEY = ["term", "country", "genre", "period", "granularity"]


def upsert_popularity(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One row per popularity key: the one pulled last."""
    return upsert_stream(rows, path, checkpoint, POPULARITY_KEY, ["pulled_at", "pop_1to100"], ["granularity", "period"])
