"""Keyed merges, appends and exports on Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def last_wins(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str],
              first_wins: Sequence[str] = (), smallest: Sequence[str] = ()) -> DataFrame:
    """Merge ``new`` into ``old`` on ``key``: the row with the greatest ``order`` stays.

    ``first_wins`` columns keep their earliest value, ``smallest`` ones their minimum. One
    aggregation over the union, combined before the shuffle, so hot keys stay cheap.
    """
    rows = old.unionByName(new)
    special = {*key, *first_wins, *smallest}
    payload = [c for c in old.columns if c not in special]
    stamp = F.struct(*order)
    aggregates = [F.max_by(F.struct(*payload), stamp).alias("_last")]
    aggregates += [F.min_by(F.struct(c), stamp).alias(f"_first_{c}") for c in first_wins]
    aggregates += [F.min(c).alias(f"_min_{c}") for c in smallest]
    merged = rows.groupBy(*key).agg(*aggregates)

    def value(column: str) -> Column:
        if column in key:
            return F.col(column)
        if column in first_wins:
            return F.col(f"_first_{column}")[column].alias(column)
        if column in smallest:
            return F.col(f"_min_{column}").alias(column)
        return F.col("_last")[column].alias(column)

    return merged.select(*[value(c) for c in old.columns])


def insert_if_absent(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append the rows of ``new`` whose key is unknown; its earliest row per key counts."""
    payload = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")).select(
        *key, *[F.col("_row")[c].alias(c) for c in payload])
    return old.unionByName(first.join(old.select(*key), list(key), "left_anti"))


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace only the partitions present in ``df`` (which must not read ``path`` itself)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished pointers of a published table, ascending."""
    files, target = _file_system(spark, f"{root}/pointers")
    if not files.exists(target):
        return []
    names = [status.getPath() for status in files.listStatus(target)]
    return sorted(int(p.getName()) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(df: DataFrame, root: str) -> str:
    """Write a new version of a keyed table, then a pointer with the next number.

    A job cannot overwrite the files it reads, so each merge writes a new folder. Older pointers stay, so readers
    always find one.
    """
    spark = df.sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    number = max(_pointers(spark, root), default=0) + 1
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.json(f"{root}/pointers/{number:012d}")
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    newest = max(_pointers(spark, root))
    path = spark.read.schema("path string").json(f"{root}/pointers/{newest:012d}").first().path
    return spark.read.parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
