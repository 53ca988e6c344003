"""Helpers shared by the corpus operators: input columns, shipping, staged prefix sums."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandscope.session import stage, staging_root

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only what an operator needs, under fixed names, so that other columns cannot clash; null text is empty."""
    return docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)


def with_offsets(runs: DataFrame, order: list[str], total: str, label: str) -> DataFrame:
    """The runs ``order`` with ``base``, the sum of ``total`` over all runs before each one.

    One row per partition of the data, so the window over all of them is small. The result is written to the
    shared folder: its size is then known, and Catalyst broadcasts it only where it is below the limit.
    """
    totals = runs.groupBy(*order).agg(F.sum(total).alias("total"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return stage(totals.select(*order, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), label)


def stage_packed(df: DataFrame, label: str) -> DataFrame:
    """Like ``stage``, for whole texts: compressed harder."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/demandscope/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free what this worker keeps between tasks: words cached by the tokenizers, and memory that nothing uses any more."""
    if cached := sys.modules.get("demandscope.llm.tokenize"):
        cached._ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable) -> Callable:
    """A task that gives memory back before it starts and when it ends: a worker outlives its tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once for each row: nothing is pushed or copied through the explode."""
    fresh = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    return df.select("*", fresh).select(*df.columns, "_once.*")
