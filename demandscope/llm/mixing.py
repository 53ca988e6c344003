"""Mixing sources to target weights by proportionate fair (Pfair) scheduling, in DataFrame functions only.

A source's documents, in id order, are a stream that is cut into blocks of so many characters. Block i (from 0) of a
source with weight a of L is released at slot floor(i L / a) and due by slot ceil((i + 1) L / a). Earliest deadline
first among the released blocks meets every deadline, so after any number of slots a source is less than one block
away from its share. The weights are whole numbers, so the schedule repeats every L slots: one period is worked out
once, and a block's slot follows from its number. When a source has run out its later slots stay empty, and the others
go on in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandscope.functions.text import let
from demandscope.session import stage

BLOCK_CHARS = 1 << 16
PERIOD = 1000  # about the sum of the default weights
TEMPERATURE = 0.5  # default weights: a source's characters to this power


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, chars, begin: characters of the source before the document.

    Prefix sums in two passes: inside range partitions, which cut a large source in many, and over their totals.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[source_col], F.lit("")).alias("source"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("chars"))
    order = ["source", "doc_id", "chars"]
    ranged = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-rows")
    totals = ranged.groupBy("source", "part").agg(F.sum("chars").alias("total"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(totals.select("source", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "mix-bases")
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "chars").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("inside", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(
        bases, ["source", "part"]).select("doc_id", "source", "chars", (F.col("base") + F.col("inside")).alias("begin"))


def default_weights(rows: DataFrame, period: int = PERIOD, temperature: float = TEMPERATURE) -> DataFrame:
    """source, weight: whole numbers of at least 1, in proportion to characters ** temperature."""
    sizes = rows.groupBy("source").agg(F.pow(F.sum("chars") + 1, F.lit(temperature)).alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    return sizes.select(
        "source", F.greatest(F.lit(1), F.round(F.lit(period) * F.col("size") / total)).cast("long").alias("weight"))


def _edf(weights: Column, period: Column) -> Column:
    """The source picked in each slot of a period: earliest deadline first among the released, ties by place.

    The state holds the next block of each source. A slot looks at each source once, so a period takes
    (sources x period) steps.
    """
    def block(place: Column, number: Column) -> Column:
        weight = F.get(weights, place)
        return F.struct(F.ceil((number + 1) * period / weight).alias("due"), place.alias("place"),
                        F.floor(number * period / weight).alias("release"), number.alias("number"))

    def step(state: Column, slot: Column) -> Column:
        pick = F.array_min(F.filter(state["next"], lambda b: b["release"] <= slot))["place"]
        return let(pick, lambda chosen: F.struct(
            F.transform(state["next"], lambda b: F.when(b["place"] == chosen, block(b["place"], b["number"] + 1)).otherwise(b)).alias("next"),
            F.concat(state["picked"], F.array(chosen)).alias("picked")))

    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.size(weights) - 1), lambda place: block(place, F.lit(0).cast("long"))).alias("next"),
        F.array().cast("array<int>").alias("picked"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step)["picked"]


def schedule(weights: DataFrame) -> DataFrame:
    """source, weight, period, slots: the slots of one period that belong to the source. One row per source."""
    all_sources = weights.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("own"), F.sum("weight").alias("period")).where(
        "period > 0")
    picked = all_sources.select("own", "period", _edf(F.col("own.weight"), F.col("period")).alias("picked"))
    slots = picked.select("own", "period", F.posexplode("picked").alias("slot", "place"))
    return slots.groupBy(F.get("own", F.col("place")).alias("own"), "period").agg(
        F.sort_array(F.collect_list(F.col("slot").cast("long"))).alias("slots")).select(
        "own.source", "own.weight", "period", "slots")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, chars, begin, block, slot, release, deadline.

    ``weights`` (source, weight: whole numbers above 0) has a row for every source; one that it leaves out has weight 1.
    The mix is the order by slot, then begin, then doc_id. A null source is the source "". Null text has no characters.
    A document belongs to the block in which it begins; one that is longer than a block leaves the next ones empty.
    Documents of the same id go by length. No rows give no rows; other columns are not read.
    """
    rows = stage(streams(docs, id_col, text_col, source_col), "mix-streams")
    if weights is None:
        weights = default_weights(rows)
    else:
        named = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("long").alias("weight"))
        weights = rows.select("source").distinct().join(
            named.groupBy("source").agg(F.max("weight").alias("weight")), "source", "left").select(
            "source", F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))).cast("long").alias("weight"))
    plan = stage(schedule(weights), "mix-schedule")
    block = F.floor(F.col("begin") / block_chars)
    return rows.withColumn("block", block).join(plan, "source").select(
        "doc_id", "source", "chars", "begin", "block",
        (F.floor(F.col("block") / F.col("weight")) * F.col("period")
         + F.get("slots", (F.col("block") % F.col("weight")).cast("int"))).alias("slot"),
        F.floor(F.col("block") * F.col("period") / F.col("weight")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("period") / F.col("weight")).alias("deadline"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the mix, which the files keep when they are written.

    Rows of the same id, source and length share a place.
    """
    placed = mix(docs, weights, block_chars).groupBy("doc_id", "source", "chars").agg(
        F.min("slot").alias("slot"), F.min("begin").alias("begin")).select(
        F.struct("slot", "begin", "doc_id").alias("place"), "doc_id", "source", "chars")
    d, p = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).alias("d"), placed.alias("p")
    joined = d.join(
        p, F.col("d.row.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.coalesce(F.col("d.row.source"), F.lit("")) == F.col("p.source"))
        & (F.length(F.coalesce(F.col("d.row.text"), F.lit(""))) == F.col("p.chars")))
    ordered = joined.select("row", "place").repartitionByRange("place").sortWithinPartitions("place")
    return ordered.select("row.*")
