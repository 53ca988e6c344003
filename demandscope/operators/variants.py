"""Spelling variants: fuzzy pairs and greedy grouping.

Two terms are close when the LCS ratio of their squashed forms reaches 88. For lengths
n >= m that allows at most k insertions and deletions. Cut the longer string into k + 1
pieces: some piece j (from 0) is untouched, has exactly j edits to its left and at most k - j
to its right (take the first prefix of pieces with fewer edits than pieces). So that piece
occurs in the shorter string at one of at most j + 1 known places, and pieces meet
substrings in an equi-join keyed by storefront, both lengths, piece and text.

What is left and right of the piece are two strings with fewer edits, to which the same holds. So where
many pieces and many substrings have one key, one of the two is cut in turn and its untouched piece joins the key,
until few share it or no letters are left; candidates grow with the rows of the join, not with their square.
A bounded ``levenshtein`` and the exact ratio decide; no pair of close forms is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandscope.config import THRESHOLDS as T
from demandscope.functions.similarity import lcs_length
from demandscope.functions.text import squash
from demandscope.session import Staged, stage


LETTERS = 2  # shorter pieces tell too little apart


def _with_squashed(terms: DataFrame) -> DataFrame:
    return terms.select("storefront", "term").distinct().withColumn("squashed", squash(F.col("term")))


def squashed_terms(terms: DataFrame) -> DataFrame:
    """Distinct (storefront, term) with the squashed form; terms squashed to nothing stay out."""
    return _with_squashed(terms).filter(F.col("squashed") != "")


def _segment(budget: Column, place: Column, length: Column, at: Column, size: Column) -> Column:
    """A stretch of the longer form with the stretch of the own form that faces it, ``budget`` edits apart at most.

    ``rank``, the letters of a piece, comes first: the greatest segment is cut next. All but ``at`` and ``size``
    are the same for both sides of a key.
    """
    return F.struct((length / (budget + 1)).alias("rank"), place.cast("int").alias("place"), length.cast("int").alias("length"),
                    budget.cast("int").alias("budget"), at.cast("int").alias("at"), size.cast("int").alias("size"))


def _sides(forms: DataFrame, ratio: int) -> tuple[DataFrame, DataFrame]:
    """Each form as the longer side, for every length a partner may have, and as the shorter side; ``k`` edits at most."""
    size = F.length("squashed")
    letters = F.aggregate(F.split("squashed", ""), F.lit(0).cast("bigint"), lambda bits, letter: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(letter) % 64)))  # an edit turns one bit
    known = stage(forms.select("storefront", "squashed", size.alias("own"), letters.alias("letters"))
                  .repartition(2 * forms.sparkSession.sparkContext.defaultParallelism), "forms")
    shortest = F.greatest(F.ceil(F.col("own") * ratio / F.lit(200 - ratio)).cast("int"), F.lit(1))
    longest = F.floor(F.col("own") * (200 - ratio) / F.lit(ratio)).cast("int")

    def side(name: str, n: Column, m: Column) -> DataFrame:
        each = known.select("storefront", F.col("squashed").alias(name), F.col("letters").alias(f"letters_{name}"), "own",
                            n.alias("n"), m.alias("m"))
        most = F.floor((F.col("n") + F.col("m")) * (100 - ratio) / F.lit(100))
        apart = F.col("n") - F.col("m")
        k = (most - (most + apart) % 2).cast("int")
        zero = F.lit(0)
        return each.withColumn("k", k).filter((F.col("k") > 0) & (F.col("k") >= apart)).select(
            "storefront", name, f"letters_{name}", "k", F.xxhash64("n", "m").alias("key"),
            F.array(_segment(F.col("k"), zero, F.col("n"), zero, F.col("own"))).alias("segments"))

    own = F.col("own")
    return side("longer", own, F.explode(F.sequence(shortest, own))), side("shorter", F.explode(F.sequence(own, longest)), own)


def _start(piece: Column) -> Column:
    """Where a piece of the segment to cut begins (from 0)."""
    return F.floor(piece * F.col("seg.length") / (F.col("seg.budget") + 1)).cast("int")


def _cut(side: DataFrame, name: str) -> DataFrame:
    """Cut the greatest segment of each row: a row for each piece of it (and place of that in the shorter form), whose text joins the key.

    ``more``: there are segments left to cut.
    """
    keep = ["storefront", name, f"letters_{name}", "k"]
    cut = side.select(*keep, "key", F.array_max("segments").alias("seg"), "segments")
    pieces = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("seg.budget"))).alias("piece"))
    # of the edits left of the piece some lengthen the shorter form and the rest cut it
    shift = F.explode(F.sequence(-F.col("piece"), F.col("piece"), F.lit(2))) if name == "shorter" else F.lit(0)
    placed = pieces.select("*", shift.alias("shift"), _start(F.col("piece")).alias("p"), _start(F.col("piece") + 1).alias("q"))
    seg, at, end = F.col("seg"), F.col("p") + F.col("shift"), F.col("q") + F.col("shift")
    inside = (at >= 0) & (end <= seg["size"]) & (
        F.abs(seg["size"] - end - seg["length"] + F.col("q")) <= seg["budget"] - F.col("piece"))
    text = F.col(name).substr(seg["at"] + at + 1, F.col("q") - F.col("p"))
    more = (F.size("segments") > 1) | (F.col("p") >= LETTERS * (F.col("piece") + 1)) | (
        seg["length"] - F.col("q") >= LETTERS * (seg["budget"] - F.col("piece") + 1))
    return placed.filter(inside).select(
        *keep, F.xxhash64("key", "piece", text).alias("key"), more.alias("more"), "seg", "segments", "piece", "p", "q", "shift")


def _remaining(cut: DataFrame) -> DataFrame:
    """The rows of ``_cut`` with the segments that are left: the others, and what is left and right of the piece."""
    seg, piece, p, q, end = F.col("seg"), F.col("piece"), F.col("p"), F.col("q"), F.col("q") + F.col("shift")
    left = _segment(piece, seg["place"], p, seg["at"], p + F.col("shift"))
    right = _segment(seg["budget"] - piece, seg["place"] + q, seg["length"] - q, seg["at"] + end, seg["size"] - end)
    rest = F.concat(F.filter("segments", lambda s: s["place"] != seg["place"]),
                    F.filter(F.array(left, right), lambda s: s["rank"] >= LETTERS))
    return cut.withColumn("segments", rest).drop("seg", "piece", "p", "q", "shift", "more")


def _meetings(longer: DataFrame, shorter: DataFrame, crowd: int) -> DataFrame:
    """Pairs of forms under one key; keys with more than ``crowd`` rows on both sides are cut further."""
    key = ["key", "storefront"]
    met = None
    while True:
        longer, shorter = _cut(longer, "longer"), _cut(shorter, "shorter")
        often = stage(longer.filter("more").groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*key), "often")
        crowded = Staged(shorter.filter("more").join(often, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n")).filter(
            F.col("n") > crowd).select(*key), "crowded", n=F.count(F.lit(1)))
        none = crowded.metrics["n"] == 0
        few = longer if none else longer.join(crowded.df.withColumn("crowded", F.lit(True)), key, "left").filter(
            F.col("crowded").isNull() | ~F.col("more"))
        # both sides are many times their file, by whose size Spark would broadcast them
        pairs = few.select(*key, "longer", "letters_longer", "k").join(
            shorter.select(*key, "shorter", "letters_shorter").hint("merge"), key).drop("key")
        met = pairs if met is None else met.unionByName(pairs)
        if none:
            return met
        longer, shorter = [stage(_remaining(side.filter("more").join(crowded.df, key, "left_semi")), "crowd")
                           for side in (longer, shorter)]


def close_forms(forms: DataFrame, ratio: int = T.fuzzy_dedup_ratio, crowd: int = 500) -> DataFrame:
    """Pairs of different squashed forms at or above the ratio (``longer``, ``shorter``)."""
    a, b = F.col("longer"), F.col("shorter")
    candidates = (
        _meetings(*_sides(forms, ratio), crowd)
        .filter(F.bit_count(F.col("letters_longer").bitwiseXOR(F.col("letters_shorter"))) <= F.col("k"))
        .filter((a != b) & ((F.length(a) > F.length(b)) | (a > b)))
        .filter(F.expr("levenshtein(longer, shorter, k) >= 0"))
        .select("storefront", "longer", "shorter").distinct()
    )
    scored = candidates.withColumn("common", lcs_length("longer", "shorter"))
    total = F.length("longer") + F.length("shorter")
    return scored.filter(F.col("common") * 200 >= total * ratio).select(
        "storefront", "longer", "shorter", (F.col("common") * 200 / total).alias("ratio"))


def fuzzy_pairs(terms: DataFrame, ratio: int = T.fuzzy_dedup_ratio) -> DataFrame:
    """Pairs of terms whose squashed forms differ and reach the ratio."""
    squashed = stage(squashed_terms(terms), "squashed")
    pairs = close_forms(squashed.select("storefront", "squashed").distinct(), ratio)
    left = squashed.select("storefront", F.col("term").alias("a"), F.col("squashed").alias("longer"))
    right = squashed.select("storefront", F.col("term").alias("b"), F.col("squashed").alias("shorter"))
    joined = pairs.join(left.hint("merge"), ["storefront", "longer"]).join(right.hint("merge"), ["storefront", "shorter"])
    return joined.select(
        "storefront", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ratio")


def variant_heads(terms: DataFrame, ratio: int = T.fuzzy_dedup_ratio) -> DataFrame:
    """Every distinct term with the head of its spelling group, per storefront.

    Terms in order of (length, text) join the first group that holds a close term.
    That equals: the head of a term is the smallest head among itself and its earlier close
    terms, a fixpoint reached by lowering heads along the pairs and
    through the heads themselves. It is not connected components: a term close to two groups
    joins the first and does not merge them. Terms without a close term stay out of the rounds.
    """
    every = stage(_with_squashed(terms), "squashed")
    squashed = every.filter(F.col("squashed") != "")
    pairs = close_forms(squashed.select("storefront", "squashed").distinct(), ratio)
    same = squashed.select("storefront", F.col("squashed").alias("x"), F.col("squashed").alias("y")).distinct()
    forms = same.unionByName(pairs.select("storefront", F.col("longer").alias("x"), F.col("shorter").alias("y"))) \
        .unionByName(pairs.select("storefront", F.col("shorter").alias("x"), F.col("longer").alias("y")))
    rank = F.struct(F.length("term").alias("size"), F.col("term").alias("text"))
    ranked = squashed.select("storefront", "squashed", rank.alias("t"))
    earlier = stage(
        ranked.select("storefront", F.col("squashed").alias("x"), F.col("t"))
        .join(forms.hint("merge"), ["storefront", "x"])
        .join(ranked.select("storefront", F.col("squashed").alias("y"), F.col("t").alias("s")).hint("merge"), ["storefront", "y"])
        .filter(F.col("s") < F.col("t")).select("storefront", "t", "s").distinct(), "earlier")

    linked = earlier.select("storefront", "t").unionByName(earlier.select("storefront", F.col("s").alias("t"))).distinct()
    heads = Staged(linked.withColumn("h", F.col("t")), "heads")
    lowering = True
    while lowering:
        known = heads.df
        via = known.select("storefront", F.col("t").alias("s"), F.col("h").alias("g"))
        offers = earlier.join(via.hint("merge"), ["storefront", "s"]).select("storefront", "t", "g") \
            .unionByName(known.select("storefront", "t", F.col("h").alias("s")).join(
                via.hint("merge"), ["storefront", "s"]).select("storefront", "t", "g")) \
            .groupBy("storefront", "t").agg(F.min("g").alias("g"))
        lowered = Staged(known.join(offers.hint("merge"), ["storefront", "t"], "left").select(
            "storefront", "t", F.least("h", F.coalesce("g", "h")).alias("h"),
            (F.coalesce("g", "h") < F.col("h")).alias("lowered")), "heads",
            n_lowered=F.count_if("lowered"))
        heads.drop()
        heads = lowered
        lowering = heads.metrics["n_lowered"] > 0
    head = heads.df.select("storefront", F.col("t.text").alias("term"), F.col("h.text").alias("head"))
    return every.join(head.hint("merge"), ["storefront", "term"], "left").select(
        "storefront", "term", F.coalesce("head", "term").alias("head"))
