"""SQL expressions shared by the oracle statements."""

from demandscope.config import (
    BRAND_HINTS, BROAD_TERMS, GIANT_SELLERS, IRREGULAR_PLURALS, STOPWORDS, TAIL_FILLER,
    TAIL_GENERIC, TITLE_NOISE,
)


def text_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


STOP, BROAD, HINTS = text_list(STOPWORDS), text_list(BROAD_TERMS), text_list(BRAND_HINTS)
NOISE, GENERIC = text_list(TITLE_NOISE), text_list(TAIL_GENERIC)


def norm(x):
    return (f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s\\-+&'']', ' ', 'g'), "
            f"'\\s+', ' ', 'g'))")


def toks(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda tk: tk <> '')"


def sing(x):
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR_PLURALS.items())
    return f"""(CASE
      WHEN length({x}) < 4 OR regexp_matches({x}, '[^\\x00-\\x7F]') THEN {x}
      WHEN {x} IN {text_list(IRREGULAR_PLURALS)} THEN CASE {x} {irregular} END
      WHEN regexp_matches({x}, '(ss|us|is)$|^(news|series|species)$') THEN {x}
      WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN {x}[:-4] || 'y'
      WHEN regexp_matches({x}, '(ch|sh|x|ss|zz)es$') THEN {x}[:-3]
      WHEN {x} LIKE '%s' THEN {x}[:-2] ELSE {x} END)"""


def sings(xs):
    return f"list_transform({xs}, lambda sg: {sing('sg')})"


def content(x):
    return sings(f"list_filter({toks(x)}, lambda st: st NOT IN {STOP})")


def squash(x):
    return f"array_to_string({sings(toks(x))}, '')"


def all_broad(x):
    return f"len(list_filter({toks(x)}, lambda ab: ab NOT IN {BROAD})) = 0"


def can_lead(x):
    return f"(len({toks(x)}) >= 2 AND {x} NOT IN {BROAD} AND NOT ({all_broad(x)}))"


def giant(x):
    return f"coalesce(regexp_matches(lower({x}), '{'|'.join(GIANT_SELLERS)}'), false)"


def head(x):
    return f"regexp_extract({x}, '^[^:\\-|–—]*')"


def flat(x):
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def brand_toks(x):
    words = toks(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")
    kept = f"list_filter({words}, lambda bt: bt NOT IN {NOISE})"
    return f"list_filter({kept}, lambda bt, bi: list_position({kept}, bt) = bi)"


def lcs(a, b):
    """Bit-parallel longest common subsequence of strings shorter than 126 characters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length({a}) + 1), lambda la: "
            f"CASE WHEN substr({a}, la, 1) = substr({b}, lb, 1) THEN 1::HUGEINT << (la - 1)::INT "
            f"ELSE 0::HUGEINT END)), lambda lp, lq: lp + lq)")
    masks = f"list_transform(range(1, length({b}) + 1), lambda lb: {mask})"
    state = (f"list_reduce(list_prepend({full}, {masks}), lambda ls, lm: "
             f"((ls + (ls & lm)) | (ls - (ls & lm))) & {full})")
    return f"(length({a}) - bit_count({state}))"


def name_match(term, title):
    t = f"coalesce({title}, '')"
    q, h = brand_toks(term), brand_toks(head(t))
    fq, fh = flat(term), flat(head(t))
    return f"""(CASE WHEN len({q}) = 0 OR len({h}) = 0 THEN 0.0
      WHEN array_to_string({q}, '') = array_to_string({h}, '') THEN 1.0
      WHEN {fq} <> '' AND {fq} = {fh} THEN 1.0
      WHEN {fq} <> '' AND {fh} <> '' AND {lcs(fq, fh)} * 200 >= 70 * (length({fq}) + length({fh})) THEN 1.0
      ELSE len(list_intersect({q}, {h}))::DOUBLE / len(list_distinct(list_concat({q}, {h}))) END)"""


def token_set(a, b):
    """Token-set ratio of two columns; needs plain column names."""
    sa, sb = f"list_sort(list_distinct({toks(a)}))", f"list_sort(list_distinct({toks(b)}))"
    common = f"list_sort(list_intersect({sa}, {sb}))"
    ra = f"array_to_string(list_filter({sa}, lambda r1: NOT list_contains({sb}, r1)), ' ')"
    rb = f"array_to_string(list_filter({sb}, lambda r2: NOT list_contains({sa}, r2)), ' ')"
    return sa, sb, common, ra, rb


def half_up(x, digits):
    unit = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({x})::DOUBLE * {unit} + 0.5) / {unit})"


def tail(x):
    clean = "trim(regexp_replace(regexp_replace(lower(pt), '[^\\p{L}\\p{N}_\\s&+]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return (f"list_filter(list_transform(string_split_regex({x}, '\\s*[–—\\-:|,]\\s+|\\s+[–—]\\s*|:\\s*'), "
            f"lambda pt: {clean}), lambda pc: pc <> '')")


FILLER = "|".join(TAIL_FILLER)


def trim_filler(x):
    return (f"regexp_replace(regexp_replace({x}, '^(?:(?:{FILLER})(?: |$))+', ''), "
            f"'(?:(?:^| )(?:{FILLER}))+$', '')")
