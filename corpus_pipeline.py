"""From raw documents to packed token sequences: filter, deduplicate, mix, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandscope.llm.common import read
from demandscope.llm.exact_dedup import without_copies
from demandscope.llm.mixing import mixed
from demandscope.llm.ngram_jaccard import representatives
from demandscope.llm.packing import pack
from demandscope.llm.quality_rules import passing
from demandscope.session import staging_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio accept."""
    return passing(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix, which the files keep."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; documents are taken in the order of their files, so ``docs`` must be read from files."""
    file = F.col("_metadata.file_name")
    number = F.lpad(F.regexp_extract(file, r"part-(\d+)", 1), 12, "0")  # part-100000 comes after part-99999
    return pack(docs, place=(F.concat_ws("/", number, file), F.col("_metadata.row_index")))


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

ORACLE_SQL = None  # neither hashed n-grams nor tokenizers can be had in SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{staging_root(spark)}/demandscope/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
