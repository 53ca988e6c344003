"""Column functions on search terms, titles and tokens. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from demandscope.config import (
    BRAND_HINTS, BROAD_TERMS, GIANT_SELLERS, IRREGULAR_PLURALS, STOPWORDS,
    TAIL_FILLER, TAIL_GENERIC, THRESHOLDS, TITLE_NOISE, UNCHANGED_PLURALS,
)


def words(values: Iterable[str]) -> Column:
    """A constant string array."""
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain alias would be inlined by the optimizer into every lambda that
    mentions it and evaluated again per element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# All but a-z, 0-9 and -+&' (and line feeds), as ranges: the negated class of those took Java about 15 times as long (measured without the space).
ODD = r"[\x00-\x25\x28-\x2A\x2C\x2E\x2F\x3A-\x60\x7B-\x{10FFFF}]+"
ODD_IN_LINES = ODD.replace(r"\x00-\x25", r"\x00-\x09\x0B-\x25")


def normalize_term(term: Column) -> Column:
    """Lower case, ASCII letters, digits and ``-+&'`` only, single spaces (in one pass)."""
    return F.trim(F.regexp_replace(F.lower(term), ODD, " "))


def normalized_lines(text: Column) -> Column:
    """The lines of a text, each as ``normalize_term`` gives it but for one space at either end, in one pass over the text."""
    return F.split(F.regexp_replace(F.lower(text), ODD_IN_LINES, " "), "\n")


def tokens(term: Column) -> Column:
    """Whitespace tokens, no empty ones."""
    return F.array_remove(F.split(term, r"\s+"), "")


def singularize(token: Column) -> Column:
    """Singular of an English plural; non-ASCII and short tokens are left alone."""
    size = F.length(token)
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR_PLURALS.items() for x in kv])
    return (
        F.when(~token.endswith("s") & ~token.isin(*IRREGULAR_PLURALS), token)  # most tokens; spares them the patterns
        .when((size < 4) | token.rlike(r"[^\x00-\x7F]"), token)
        .when(F.map_contains_key(irregular, token), F.try_element_at(irregular, token))
        .when(token.rlike(f"(ss|us|is)$|^({'|'.join(UNCHANGED_PLURALS)})$"), token)
        .when((size > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), size - 3), F.lit("y")))
        .when(token.rlike("(ch|sh|x|ss|zz)es$"), token.substr(F.lit(1), size - 2))
        .when(token.endswith("s"), token.substr(F.lit(1), size - 1))
        .otherwise(token)
    )


def content_tokens(term: Column) -> Column:
    """Tokens without stopwords, then singular."""
    return F.transform(F.filter(tokens(term), lambda t: ~t.isin(*STOPWORDS)), singularize)


def squash(term: Column) -> Column:
    """Singular tokens glued together: the form spelling variants are compared on."""
    return F.array_join(F.transform(tokens(term), singularize), "")


def root_matches(root: Column, term: Column) -> Column:
    """Every token of the root is a whole token of the term (a dash separates tokens)."""
    spaced = tokens(F.translate(term, "-", " "))
    return F.size(F.array_except(tokens(root), spaced)) == 0


def looks_like_brand(term: Column) -> Column:
    return F.arrays_overlap(tokens(term), words(BRAND_HINTS))


def is_giant(seller: Column) -> Column:
    return F.coalesce(F.lower(seller).rlike("|".join(GIANT_SELLERS)), F.lit(False))


def all_broad(term: Column) -> Column:
    return F.forall(tokens(term), lambda t: t.isin(*BROAD_TERMS))


def links_allowed(term: Column) -> Column:
    """May this term tie two others into one cluster?"""
    return ~all_broad(term)


def eligible_head(term: Column, min_tokens: int = THRESHOLDS.min_tokens_for_head) -> Column:
    return (F.size(tokens(term)) >= min_tokens) & ~term.isin(*BROAD_TERMS) & ~all_broad(term)


def title_head(title: Column) -> Column:
    """The part of a title before its first separator."""
    return F.regexp_extract(title, r"^[^:\-|–—]*", 0)


def brand_tokens(text: Column) -> Column:
    """Distinct ASCII words of a name, without title noise, in order of appearance."""
    # all but a-z, 0-9 and white space
    cleaned = F.regexp_replace(F.lower(text), r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x{10FFFF}]", " ")
    return F.array_except(tokens(cleaned), words(TITLE_NOISE))


def flat(text: Column) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x{10FFFF}]+", "")


def clean_part(part: Column) -> Column:
    """Unicode words plus ``&`` and ``+``, single spaces."""
    kept = F.regexp_replace(F.lower(part), r"(?U)[^\w\s&+]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def _trim_filler(part: Column) -> Column:
    filler = "|".join(TAIL_FILLER)
    left = F.regexp_replace(part, f"^(?:(?:{filler})(?: |$))+", "")
    return F.regexp_replace(left, f"(?:(?:^| )(?:{filler}))+$", "")


# Fixed value: the separators between a name and its description.
TAIL_SEPARATOR = r"\s*[–—\-:|,]\s+|\s+[–—]\s*|:\s*"


def descriptor_tail(term: Column) -> Column:
    """The descriptive half of ``name <separator> description``, or null."""

    def choose(parts: Column) -> Column:
        longest = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
            F.lit(""),
            lambda best, part: F.when(
                F.size(tokens(part)) > F.size(tokens(best)), part).otherwise(best),
        )
        return let(_trim_filler(longest), lambda tail: let(F.split(tail, " "), lambda ws: F.when(
            (F.size(parts) >= 2)
            & (tail != "")
            & ~((F.size(ws) < 2) & (tail.isin(*TAIL_GENERIC) | (F.length(tail) < 4)))
            & ~F.forall(ws, lambda w: w.isin(*TAIL_GENERIC))
            & (tail != _trim_filler(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))),
            tail,
        )))

    parts = F.filter(F.transform(F.split(term, TAIL_SEPARATOR), clean_part), lambda p: p != "")
    return let(parts, choose)
