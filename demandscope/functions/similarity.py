"""String similarity on longest common subsequences.

``ratio`` is 100 * 2 * LCS / (len a + len b): insertions and deletions only, so it is
not the Levenshtein ratio. Spark has no LCS, hence one Arrow-batched Pandas UDF; callers
send it only the pairs that survive Spark's own ``levenshtein`` (never larger than
the number of insertions and deletions), every other row passes null.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from demandscope import labels
from demandscope.config import THRESHOLDS
from demandscope.functions.text import brand_tokens, flat, let, title_head, tokens


# workers get the function itself, so they need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lcs(a: str, b: str) -> int:
    """Bit-parallel LCS length: one big-integer step per character of ``b``."""
    places: dict[str, int] = {}
    for place, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << place
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        hit = state & places.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b)], dtype="Int32"
    )


def within_ratio(a: Column, b: Column, ratio: int) -> Column:
    """A native bound: false means the ratio is certainly below ``ratio``."""
    budget = F.floor((F.length(a) + F.length(b)) * (100 - ratio) / F.lit(100)).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= budget) & (F.levenshtein(a, b) <= budget)


def ratio_at_least(a: Column, b: Column, ratio: int) -> Column:
    """Exact ``ratio(a, b) >= ratio`` in integers; false for empty strings."""
    close = (a != "") & (b != "") & within_ratio(a, b, ratio)
    common = lcs_length(F.when(close, a), F.when(close, b))
    return F.coalesce(common * 200 >= (F.length(a) + F.length(b)) * ratio, F.lit(False))


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _names(q: Column, h: Column, flat_q: Column, flat_h: Column) -> dict[str, Column]:
    return {
        "empty": (F.size(q) == 0) | (F.size(h) == 0), "equal": F.array_join(q, "") == F.array_join(h, ""),
        "jaccard": F.size(F.array_intersect(q, h)) / F.greatest(F.size(F.array_union(q, h)), F.lit(1)),
        "term": flat_q, "head": flat_h}


def name_parts(term: Column, title: Column) -> Column:
    """What ``name_match`` compares, for a column of its own: it is worked out once, where branches of a condition each repeat it."""
    head = title_head(F.coalesce(title, F.lit("")))
    return let(brand_tokens(term), lambda q: let(brand_tokens(head), lambda h: _struct(_names(q, h, flat(term), flat(head)))))


def name_match_of(parts: Column | dict[str, Column]) -> Column:
    return (
        F.when(parts["empty"], 0.0)
        .when(parts["equal"], 1.0)
        .when((parts["term"] != "") & (parts["term"] == parts["head"]), 1.0)
        .when(ratio_at_least(parts["term"], parts["head"], THRESHOLDS.brand_ratio), 1.0)
        .otherwise(parts["jaccard"])
    )


def name_match(term: Column, title: Column) -> Column:
    """How closely a query matches a name, 0..1; 1 means the query is that name."""
    head = title_head(F.coalesce(title, F.lit("")))
    return name_match_of(_names(brand_tokens(term), brand_tokens(head), flat(term), flat(head)))


def brand_signal(term: Column, title: Column, seller: Column) -> Column:
    """Which signal says the query is somebody's brand; empty string when none does."""
    title = F.coalesce(title, F.lit(""))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    first_word = F.try_element_at(tokens(plain(title)), F.lit(1))
    return (
        F.when(name_match(term, title) >= THRESHOLDS.brand_suspect, labels.BRAND_BY_TITLE)
        .when(name_match(term, seller) >= THRESHOLDS.brand_suspect, labels.BRAND_BY_SELLER)
        .when((F.size(tokens(plain(term))) == 1) & (first_word == plain(term)),
              labels.BRAND_BY_FIRST_WORD)
        .otherwise("")
    )


def _sets(sa: Column, sb: Column) -> dict[str, Column]:
    return {
        "empty": (F.size(sa) == 0) | (F.size(sb) == 0), "rest_a": F.array_join(F.array_except(sa, sb), " "),
        "rest_b": F.array_join(F.array_except(sb, sa), " "), "common": F.length(F.array_join(F.array_intersect(sa, sb), " "))}


def _ordered(text: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens(text)))


def token_sets(a: Column, b: Column) -> Column:
    """The common and the remaining tokens that ``token_set_ratio`` compares, for a column of their own like ``name_parts``."""
    return let(_ordered(a), lambda sa: let(_ordered(b), lambda sb: _struct(_sets(sa, sb))))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Token-set ratio, 0..100, by lengths of the sorted common and remaining tokens.

    A common prefix does not change the number of insertions and deletions, so one LCS
    over the two remainders is enough.
    """
    return token_set_ratio_of(_sets(_ordered(a), _ordered(b)))


def token_set_ratio_of(sets: Column | dict[str, Column]) -> Column:
    rest_a, rest_b = sets["rest_a"], sets["rest_b"]
    has_rest = (rest_a != "") & (rest_b != "")
    lcs = lcs_length(F.when(has_rest, rest_a), F.when(has_rest, rest_b))

    len_a, len_b = F.length(rest_a), F.length(rest_b)
    len_common = sets["common"]
    glue = F.when(len_common > 0, 1).otherwise(0)
    both = len_common * 2 + glue * 2 + len_a + len_b
    score = lambda distance, total: 100 - 100 * distance / total
    full = score(len_a + len_b - 2 * lcs, both)
    with_common = F.greatest(
        full,
        score(glue + len_a, len_common * 2 + glue + len_a),
        score(glue + len_b, len_common * 2 + glue + len_b),
    )
    return (
        F.when(sets["empty"], 0.0)
        .when((len_common > 0) & ~has_rest, 100.0)
        .when(len_common > 0, with_common)
        .otherwise(full)
    )
