"""PII: patterns, and information-theoretic sanitisation of the terms around what they find. DataFrame functions only.

An address, number or card found by a pattern is a protected entity. A term next to it reveals it as far as meeting the
term makes the entity likely: with IC(e) = -log p(e) the information of the entity and PMI(e, t) = log p(e | t) / p(e)
what the term tells of it, both from counts of whole documents (or of ``near`` characters around entities), the disclosure is PMI / IC; 1 means that
the term never occurs without the entity. Terms at or over the threshold are generalised; those that disclose all
are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandscope.functions.text import let
from demandscope.llm.common import id_and_text, once, stage_packed
from demandscope.session import stage

# Fixed values. The possessive and look-behind forms find the same spans as
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+ of 16 to 19 digits                \+[0-9][\x20().0-9-]+[0-9]
# leftmost and without overlap, in time linear in the text and without deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "phone": "+"}  # a text without the mark has no match
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = list(PATTERNS)

NEAR = 64  # characters on either side of an entity in which terms are looked at
SUPPORT = 3  # documents in which term and entity must lie together for an estimate
THRESHOLD = 0.8
WALK_BLOCK = 128
MOST_BITS = 1 << 27  # of a Bloom filter; with more terms it lets more words pass, which the join then drops
_SPANS = "array<struct<start:int,end:int,value:string>>"
_WORD = r"[\p{L}\p{N}]+"
_NO_WORD = r"[^\p{L}\p{N}]+"
FILL = "\U0010fffd"  # a private character in the place of those of entities
_MASKED_WORD = rf"[\p{{L}}\p{{N}}{FILL}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: every second one from the right counts twice, by digit sum."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), add) % 10 == 0


def _validity(kind: str) -> Callable[[Column], Column]:
    """Whether a match counts."""
    def valid(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        if kind == "card":
            return luhn(_digits(value))
        return F.length(_digits(value)).between(8, 15) if kind == "phone" else F.lit(True)

    return valid


def walk(items: Column, start: Column, state_type: str, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``step(state, item)`` gives the next state and one value; the values of all items, in order.

    Values are gathered in blocks and the blocks in one array, so that no long array is copied for each item.
    """
    none, blocks_of = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def one(acc: Column, item: Column) -> Column:
        return let(F.struct(*(c.alias(n) for c, n in zip(step(acc["state"], item), ("state", "out"), strict=True))), lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def block(acc: Column, i: Column) -> Column:
        own = F.slice(items, i * WALK_BLOCK + 1, WALK_BLOCK)
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    first = F.struct(start.cast(state_type).alias("state"), blocks_of.alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WALK_BLOCK).cast("int")), first, block)["out"])).otherwise(none)


def _lengths(matches: Column, gaps: Column) -> Column:
    """(gap, length, value) of each match; ``gaps`` has one more."""
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("value"))
    return F.transform(F.slice(pairs, F.lit(1), F.size(matches)), lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("n"), x["value"].alias("value")))


def _placed(lengths: Column) -> Column:
    """(start, end, value) of matches, from their lengths and those of the texts between them."""
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + x["n"]
        return end, F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))

    return walk(lengths, F.lit(0), "int", "struct<start:int,end:int,value:string>", step)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and one column of spans for each kind of entity."""
    found = once(docs, **{f"m_{kind}": (
        F.when(F.col("text").contains(MARKS[kind]), F.regexp_extract_all("text", F.lit(p), F.lit(0))) if kind in MARKS
        else F.regexp_extract_all("text", F.lit(p), F.lit(0))) for kind, p in PATTERNS.items()})
    lengths = once(found, **{f"l_{kind}": F.when(
        F.size(f"m_{kind}") > 0, _lengths(F.col(f"m_{kind}"), F.split("text", p, -1))) for kind, p in PATTERNS.items()})
    none = F.array().cast(_SPANS)
    placed = once(lengths, **{f"p_{kind}": F.when(F.size(f"l_{kind}") > 0, _placed(F.col(f"l_{kind}"))).otherwise(none) for kind in KINDS})
    return once(placed, **{kind: F.filter(f"p_{kind}", _validity(kind)) for kind in KINDS}).drop(
        *(f"{x}_{kind}" for kind in KINDS for x in "mlp"))


def _terms(text: Column, low: Column, high: Column) -> Column:
    """(start, end, value) of the words that lie wholly in text[low:high]."""
    piece = F.substring(text, low + 1, high - low)
    words = _placed(_lengths(F.regexp_extract_all(piece, F.lit(_WORD), F.lit(0)), F.split(piece, _WORD, -1)))
    letter = lambda at: F.substring(text, at, F.lit(1)).rlike(_WORD)
    cut_low, cut_high = (low > 0) & letter(low), (high < F.length(text)) & letter(high + 1)
    whole = F.filter(words, lambda w: ~(cut_low & (w["start"] == 0)) & ~(cut_high & (w["end"] == high - low)))
    return F.transform(whole, lambda w: F.struct(
        (w["start"] + low).alias("start"), (w["end"] + low).alias("end"), F.lower(w["value"]).alias("value")))


def with_contexts(found: DataFrame, near: int = NEAR) -> DataFrame:
    """Add ``contexts``: kind, value, term, start and end of every word near an entity; words of entities left out."""
    def around(kind: str) -> Callable[[Column], Column]:
        def contexts(s: Column) -> Column:
            low, high = F.greatest(F.lit(0), s["start"] - near), F.least(F.length("text"), s["end"] + near)
            terms = F.concat(_terms(F.col("text"), low, s["start"]), _terms(F.col("text"), s["end"], high))
            return F.transform(terms, lambda t: F.struct(
                F.lit(kind).alias("kind"), s["value"].alias("entity"), t["value"].alias("term"), t["start"].alias("start"),
                t["end"].alias("end")))

        return contexts

    inside = F.concat(*(F.col(kind) for kind in KINDS))
    every = F.concat(*(F.flatten(F.transform(kind, around(kind))) for kind in KINDS))
    free = F.filter(every, lambda t: ~F.exists(inside, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return once(found, contexts=F.when(F.size(inside) > 0, free).otherwise(F.array().cast(
        "array<struct<kind:string,entity:string,term:string,start:int,end:int>>")))


def disclosures(docs: DataFrame, contexts: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """kind, entity, term, disclosure of the terms at or over the threshold; counts are over all of ``docs`` (text)."""
    together = contexts.select("row_id", "kind", "entity", "term").distinct().groupBy("kind", "entity", "term").agg(
        F.count("*").alias("both")).where(F.col("both") >= support)
    entities = contexts.select("row_id", "kind", "entity").distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), _NO_WORD))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_term"))
    total = docs.count()
    told = F.log(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    whole = F.log(F.lit(float(total)) / F.col("n_entity"))
    return together.join(entities, ["kind", "entity"]).join(words, "term").withColumn(
        "disclosure", F.when(F.col("n_entity") < total, told / whole)).where(F.col("disclosure") >= threshold).select(
        "kind", "entity", "term", "disclosure")


def covered(spans: Column) -> Column:
    """The stretches (low, high) that ``spans``, ordered by start, cover together."""
    kind = "struct<low:int,high:int>"

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(reach, x["end"]), F.when(x["end"] > reach, F.struct(
            F.greatest(reach, x["start"]).alias("low"), x["end"].alias("high")))

    return F.filter(walk(spans, F.lit(0), "int", kind, step), lambda x: x.isNotNull())


def masked(texts: DataFrame) -> DataFrame:
    """``texts`` with the text as ``masked``: each character of an entity is FILL, so that places stay.

    The text is cut into blocks of stretches first, so that no stretch is looked for from the start of a long text.
    """
    ordered = F.array_sort(F.transform(F.concat(*(F.col(kind) for kind in KINDS)), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"))))
    found = once(once(texts, spans=ordered), parts=F.when(F.size("spans") > 0, covered(F.col("spans"))))
    text, parts = F.col("text"), F.col("parts")

    def block(i: Column) -> Column:
        own = F.slice(parts, i * WALK_BLOCK + 1, WALK_BLOCK)
        begin = F.when(i > 0, F.get(parts, i * WALK_BLOCK - 1)["high"]).otherwise(0)

        def cut(bound: Column) -> Column:
            low, here = bound["low"], bound["text"]
            return F.array_join(F.transform(bound["own"], lambda x, k: let(
                F.when(k > 0, F.get(bound["own"], k - 1)["high"]).otherwise(low), lambda at: F.concat(
                    F.substring(here, at - low + 1, x["low"] - at), F.repeat(F.lit(FILL), x["high"] - x["low"])))), "")

        high = F.element_at(own, -1)["high"]
        return let(F.struct(own.alias("own"), begin.alias("low"), F.substring(text, begin + 1, high - begin).alias("text")), cut)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / WALK_BLOCK).cast("int")), block)
    tail = F.substring(text, F.element_at(parts, -1)["high"] + 1, F.length(text))
    return found.withColumn("masked", F.when(parts.isNotNull(), F.concat(F.array_join(blocks, ""), tail)).otherwise(text)).drop(
        "spans", "parts", "text")


def with_words(texts: DataFrame) -> DataFrame:
    """Add ``words``, the different words of a masked text that share no character with an entity, as written."""
    words = F.filter(F.array_distinct(F.regexp_extract_all("masked", F.lit(_MASKED_WORD), F.lit(0))), lambda w: ~w.contains(FILL))
    return once(texts, words=words)


def with_terms(texts: DataFrame) -> DataFrame:
    """Add ``terms``, the same in lower case."""
    return once(with_words(texts), terms=F.array_distinct(F.transform("words", F.lower)))


def _filter_of(hashes: DataFrame, size: int) -> Callable[[Column], Column]:
    """Whether a hash may be among ``hash`` of the rows: a Bloom filter of bounded size, as an array of longs.

    The test is for use in a filter, not inside a lambda.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * size - 1).bit_length()))
    places = lambda h: [F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))]
    set_ = hashes.select(F.explode(F.array(*places(F.col("hash")))).alias("bit")).select(
        F.floor(F.col("bit") / 64).alias("id"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("word"))
    dense = hashes.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long").alias("word"))
    words = stage(set_.unionByName(dense).groupBy("id").agg(F.bit_or("word").alias("word")), "pii-filter")
    array = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words")).scalar()
    test = lambda b: F.getbit(F.get(array, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1
    return lambda h: test(places(h)[0]) & test(places(h)[1])


def whole_text_terms(texts: DataFrame, support: int, threshold: float) -> DataFrame:
    """text_id and terms of every text that holds a disclosing term, with or without an entity of its own.

    Counts are of different texts. ``texts`` has text_id, masked and the spans of each kind; texts stay where they are. Words
    are counted where they lie, and only words that a Bloom filter of the disclosing terms lets pass are joined.
    """
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("entity"))
    entity = F.array_distinct(F.concat(*(F.transform(kind, named(kind)) for kind in KINDS)))
    bearing = texts.where(" OR ".join(f"size({kind}) > 0" for kind in KINDS))
    entities = stage(bearing.select(F.explode(entity).alias("e")).groupBy("e.kind", "e.entity").agg(F.count("*").alias("n_entity")).where(
        F.col("n_entity") >= support), "pii-entities")  # others are with no term in ``support`` texts
    frequent = _filter_of(entities.select(F.xxhash64("kind", "entity").alias("hash")), entities.count())
    shared = bearing.withColumn("e", F.explode(entity)).where(frequent(F.xxhash64("e.kind", "e.entity")))
    each = with_terms(shared).select("e.*", F.explode("terms").alias("term"))
    together = stage(each.groupBy("kind", "entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support).join(
        entities, ["kind", "entity"]), "pii-together")
    total = texts.count()
    # a disclosure of t or more means n_term <= both * (N / n_entity) ** (1 - t)
    asked = together.groupBy("term").agg(F.max(F.col("both") * F.pow(
        F.lit(float(total)) / F.col("n_entity"), F.lit(1 - threshold)) * (1 + 1e-9)).alias("most"))
    words = with_terms(texts).select("text_id", F.explode("terms").alias("term"))
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(asked, "term").where(F.col("n_term") <= F.col("most"))
    told = F.log(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    full = F.log(F.lit(float(total)) / F.col("n_entity"))
    telling = stage(together.join(n_term.select("term", "n_term"), "term").withColumn(
        "disclosure", F.when(F.col("n_entity") < total, told / full)).where(F.col("disclosure") >= threshold).groupBy(
        "term").agg(F.max("disclosure").alias("disclosure")), "pii-disclosures")
    telling_hash = _filter_of(telling.select(F.xxhash64("term").alias("hash")), telling.count())
    held = words.where(telling_hash(F.xxhash64("term"))).join(telling, "term", "left_semi")
    marked = stage(held.select("text_id").distinct(), "pii-marked")
    holding = _filter_of(marked.select(F.xxhash64("text_id").alias("hash")), marked.count())
    found = once(texts.where(holding(F.xxhash64("text_id"))), lengths=_lengths(
        F.regexp_extract_all("masked", F.lit(_MASKED_WORD), F.lit(0)), F.split("masked", _MASKED_WORD, -1)))
    places = once(found, at=_placed(F.col("lengths")))
    spots = places.select("text_id", F.explode("at").alias("w")).select("text_id", "w.start", "w.end", F.lower("w.value").alias("term"))
    return spots.where(telling_hash(F.xxhash64("term"))).join(telling, "term").groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))


def pii_rows(docs: DataFrame, near: int | None = NEAR, support: int = SUPPORT, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, a column of spans for each kind, and ``terms`` (start, end, disclosure, of the disclosing terms).

    ``keep`` may name "text", for callers that rewrite it. Without ``near`` terms are counted and marked in whole texts.
    """
    rows = id_and_text(docs, id_col, text_col)
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    if near is None:
        known = rows.withColumn("text_id", F.unhex(F.sha2("text", 256)))
        texts = stage_packed(masked(find_spans(known.select("text_id", "text").dropDuplicates(["text_id"]))), "pii-texts")
        terms = whole_text_terms(texts, support, threshold)
        spans = stage(texts.select("text_id", *KINDS).join(terms, "text_id", "left").withColumn(
            "terms", F.coalesce("terms", none)), "pii-spans")
        return known.select("text_id", "doc_id", *keep).join(spans, "text_id").drop("text_id")
    found = with_contexts(find_spans(rows), near).withColumn("row_id", F.monotonically_increasing_id())
    slim = stage(found.select("row_id", "doc_id", *keep, *KINDS, "contexts"), "pii-spans")
    contexts = slim.select("row_id", F.explode("contexts").alias("c")).select("row_id", "c.*")
    told = stage(disclosures(rows.select("text"), contexts, support, threshold), "pii-disclosures")
    terms = contexts.join(told, ["kind", "entity", "term"]).groupBy("row_id", "start", "end").agg(
        F.max("disclosure").alias("disclosure")).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    return slim.drop("contexts").join(terms, "row_id", "left").withColumn(
        "terms", F.coalesce("terms", none)).drop("row_id")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def pii_spans(docs: DataFrame, near: int | None = NEAR, support: int = SUPPORT, threshold: float = THRESHOLD,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    Spans are kind:start:end in code points, the end exclusive; ``spans`` has the disclosing terms after the base
    spans. Null and empty texts have none. With ``near`` a text without an entity has no terms; with None all texts are marked. Repeated rows count as often as they
    occur. No rows give no rows; other columns are not read.
    """
    rows = pii_rows(docs, near, support, threshold, id_col, text_col)
    base = F.concat(*(_listed(kind, F.col(kind)) for kind in KINDS))
    return rows.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term", F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, near: int | None = NEAR, support: int = SUPPORT, threshold: float = THRESHOLD,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with entities as [EMAIL], ..., disclosing terms as [TERM], and terms that disclose all removed.

    Of spans that overlap the one that begins first is replaced, of those the longest.
    """
    rows = pii_rows(docs, near, support, threshold, id_col, text_col, keep=("text",))

    def marks(spans: str, text_of: Callable[[Column], Column]) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("end"), text_of(s).alias("text")))

    def label(kind: str) -> Callable[[Column], Column]:
        return lambda _: F.lit(f"[{kind.upper()}]")

    told = F.lit(1 - 1e-12)
    marked = [marks(kind, label(kind)) for kind in KINDS]
    marked.append(marks("terms", lambda s: F.when(s["disclosure"] >= told, F.lit("")).otherwise(F.lit("[TERM]"))))
    def keep(at: Column, s: Column) -> tuple[Column, Column]:
        apart = s["start"] >= at
        return F.when(apart, -s["end"]).otherwise(at), F.when(apart, F.struct(
            at.alias("from"), s["start"].alias("to"), (-s["end"]).alias("next"), s["text"].alias("text")))

    replaced = once(rows.select("doc_id", "text", F.array_sort(F.concat(*marked)).alias("marks")), parts=F.filter(walk(
        F.col("marks"), F.lit(0), "int", "struct<from:int,to:int,next:int,text:string>", keep), lambda x: x.isNotNull()))
    letters = once(replaced, letters=F.when(F.size("parts") > 0, F.split("text", "")))
    piece = lambda low, n: F.array_join(F.slice("letters", low + 1, n), "")
    last = F.element_at("parts", -1)["next"]
    return letters.select("doc_id", F.when(F.size("parts") > 0, F.concat(
        F.array_join(F.transform("parts", lambda x: F.concat(piece(x["from"], x["to"] - x["from"]), x["text"])), ""),
        piece(last, F.greatest(F.size("letters") - last, F.lit(0))))).otherwise(F.col("text")).alias("text"))
