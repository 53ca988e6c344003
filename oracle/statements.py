"""One DuckDB statement per registered query, written from the definitions."""

import re

from demandscope import labels as L
from demandscope.config import STOREFRONTS, probe_suffixes, seed_order
from oracle import bindings as _b, fragments as S

SQL: dict[str, str] = {}

SEEDS = S.text_list([v for v, _ in seed_order()])


def _strength(delta: str) -> str:
    return (f"CASE WHEN {delta} >= 50 THEN '{L.STRENGTH_UP}' WHEN {delta} <= -50 THEN '{L.STRENGTH_DOWN}' "
            f"ELSE '{L.STRENGTH_STABLE}' END")


def _movement(pop: str, lookback: int, min_delta: int, countries: str = "") -> str:
    where = f"AND b.country IN {countries}" if countries else ""
    return f"""
  SELECT b.term, b.country, b.genre, b.rank_in_genre AS rank_now, a.rank_in_genre AS rank_before,
    b.pop_1to100 AS popularity, a.rank_in_genre - b.rank_in_genre AS delta, 0 AS weeks_rising, 0 AS weeks_tracked,
    false AS is_new, {_strength('a.rank_in_genre - b.rank_in_genre')} AS strength
  FROM {pop} a JOIN {pop} b USING (term, country, genre)
  WHERE b.period = (SELECT max(period) FROM {pop})
    AND a.period = (SELECT DISTINCT period FROM {pop} ORDER BY period DESC LIMIT 1 OFFSET {lookback})
    AND abs(a.rank_in_genre - b.rank_in_genre) >= {min_delta} {where}"""


def _entrants(pop: str, absent: int, countries: str = "") -> str:
    where = f"AND country IN {countries}" if countries else ""
    return f"""
  SELECT term, country, genre, rank_in_genre AS rank_now, NULL::INT AS rank_before, pop_1to100 AS popularity, 0 AS delta,
    0 AS weeks_rising, 0 AS weeks_tracked, true AS is_new, '{L.STRENGTH_NEW}' AS strength
  FROM {pop} WHERE period = (SELECT max(period) FROM {pop}) {where} AND term NOT IN (
    SELECT term FROM {pop} WHERE period IN (SELECT DISTINCT period FROM {pop} ORDER BY period DESC LIMIT {absent} OFFSET 1))"""


def _sustained(pop: str, gain: int) -> str:
    return f"""
  SELECT term, country, genre, r_now AS rank_now, r_first AS rank_before, popularity, r_first - r_now AS delta,
    rising AS weeks_rising, 4 AS weeks_tracked, false AS is_new, '{L.STRENGTH_SUSTAINED}' AS strength
  FROM (SELECT term, country, genre, count(*) AS n, arg_max(rank_in_genre, period) AS r_now,
          arg_min(rank_in_genre, period) AS r_first, arg_max(pop_1to100, period) AS popularity,
          (count(*) FILTER (rank_in_genre < prev))::INT AS rising
        FROM (SELECT *, lag(rank_in_genre) OVER (PARTITION BY term, country, genre ORDER BY period) AS prev
              FROM {pop} WHERE period IN (SELECT DISTINCT period FROM {pop} ORDER BY period DESC LIMIT 5))
        GROUP BY 1, 2, 3)
  WHERE n = 5 AND r_first - r_now >= {gain} AND rising >= 3"""


def _seasonal(moves: str, pop: str) -> str:
    near = lambda days: (f"(SELECT period FROM (SELECT DISTINCT period FROM {pop}) WHERE abs(date_diff('day', period, "  # noqa: E731
                         f"(SELECT max(period) FROM {pop}) - {days})) <= 14 ORDER BY abs(date_diff('day', period, "
                         f"(SELECT max(period) FROM {pop}) - {days})), period LIMIT 1)")
    return f"""
  SELECT m.*, CASE WHEN m.delta = 0 OR s.rank_in_genre IS NULL OR e.rank_in_genre IS NULL OR s.period = e.period THEN NULL
      WHEN s.rank_in_genre = e.rank_in_genre THEN false
      ELSE (s.rank_in_genre - e.rank_in_genre > 0) = (m.delta > 0)
        AND abs(s.rank_in_genre - e.rank_in_genre) >= greatest(abs(m.delta) * 0.5, 30) END AS seasonal
  FROM ({moves}) m
  LEFT JOIN (SELECT * FROM {pop} WHERE period = {near(392)}) s USING (term, country, genre)
  LEFT JOIN (SELECT * FROM {pop} WHERE period = {near(364)}) e USING (term, country, genre)"""


SQL["rank_movement"] = _movement("pop", 1, 10)
SQL["rank_movement_by_genre"] = _movement("popq", 2, 10, "('asia', 'europe')")
SQL["new_entrants"] = _entrants("popf", 3, "('asia', 'europe', 'america')")
SQL["sustained_climb"] = _sustained("pop", 10)
SQL["seasonality"] = f"SELECT term, country, genre, delta, seasonal FROM ({_seasonal(_movement('pop', 1, 5), 'pop')})"
SQL["weekly_trend_view"] = f"""
SELECT 'entrant' AS section, term, country, genre, rank_now, delta, NULL::BOOLEAN AS seasonal FROM ({_entrants('popq', 3)})
UNION ALL SELECT CASE WHEN delta > 0 THEN 'rising' ELSE 'falling' END, term, country, genre, rank_now, delta, seasonal
FROM ({_seasonal(_movement('popq', 1, 10), 'popq')})"""
SQL["monthly_trend_view"] = f"""
SELECT CASE WHEN seasonal THEN 'seasonal' ELSE 'fresh' END AS section, term, country, genre, rank_now, delta,
  weeks_rising, seasonal FROM ({_seasonal(_sustained('popq', 10), 'popq')})"""
SQL["trending_union"] = f"""
SELECT term, country, popularity, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY term, country ORDER BY tier, place, genre) AS rn FROM (
    SELECT *, 1 AS tier, rank_now AS place FROM ({_entrants('popq', 3)})
    UNION ALL SELECT *, 2, -delta FROM ({_sustained('popq', 10)})
    UNION ALL SELECT *, 3, -delta FROM ({_movement('popq', 1, 10)})))
WHERE rn = 1 ORDER BY tier, place, term, country, genre LIMIT 40"""
SQL["term_history"] = """
SELECT country, genre, period, rank_in_genre, pop_1to100 FROM pop WHERE term = 'red widget'"""
SQL["distinct_periods"] = "SELECT DISTINCT period FROM popq"
SQL["popularity_statistics"] = """
SELECT count(*) AS n_rows, count(DISTINCT term) AS n_terms, count(DISTINCT period) AS n_periods,
  min(period) AS first_period, max(period) AS last_period FROM popq"""
SQL["largest_lists"] = """
SELECT genre, country, count(*) AS n FROM popq GROUP BY 1, 2 ORDER BY n DESC, genre, country LIMIT 12"""
SQL["popularity_band"] = """
SELECT term, country, max(pop_1to100) AS popularity FROM popq
WHERE period = (SELECT max(period) FROM popq) AND pop_1to100 BETWEEN 45 AND 65
GROUP BY 1, 2 ORDER BY popularity DESC, term, country LIMIT 200"""
SQL["adopt_terms"] = """
SELECT term, country AS storefront, max(pop_1to100) AS popularity FROM popf
WHERE pop_1to100 >= 95 AND country IN ('asia', 'europe') AND (term, country) NOT IN (
  SELECT ('part ' || first_part, CASE WHEN storefront = 'us' THEN 'asia' ELSE 'europe' END) FROM keywords)
GROUP BY 1, 2"""
SQL["resume_plan"] = """
SELECT period, genre FROM (
  SELECT DISTINCT date_trunc('quarter', (date_trunc('month', (SELECT max(o_orderdate) FROM orders)) - to_months(i)))::DATE AS period
  FROM (SELECT unnest(range(1, 25))::INT AS i)),
  (SELECT unnest(['economy', 'large', 'medium', 'promo', 'small', 'standard', 'luxury']) AS genre)
WHERE (period, genre) NOT IN (SELECT (period, genre) FROM popq)"""
SQL["completed_weeks"] = """
WITH last AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
weeks AS (SELECT (d - dayofweek(d)::INT - 7 * i)::DATE AS period_start FROM last, (SELECT unnest(range(1, 27))::INT AS i))
SELECT period_start, (period_start + 6)::DATE AS period_end, count(o_orderkey) AS n
FROM weeks LEFT JOIN orders ON o_orderdate::DATE BETWEEN period_start AND period_start + 6 GROUP BY 1, 2"""
SQL["completed_months"] = """
WITH months AS (SELECT (date_trunc('month', (SELECT max(o_orderdate) FROM orders)) - to_months(i))::DATE AS period_start
                FROM (SELECT unnest(range(1, 14))::INT AS i))
SELECT period_start, last_day(period_start) AS period_end, count(o_orderkey) AS n
FROM months LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = period_start GROUP BY 1, 2"""
SQL["ranked_scan"] = """
SELECT term, country, period, rank_in_genre, place FROM (
  SELECT *, (row_number() OVER (PARTITION BY genre, period ORDER BY rank_in_genre, country, term))::INT AS place FROM popq
  WHERE country IN ('asia', 'africa') AND genre = 'promo' AND period BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')
WHERE place <= 25"""
SQL["popularity_lookup"] = """
SELECT w.term, country, period, rank_in_genre, pop_1to100
FROM (SELECT DISTINCT p_name AS term FROM part WHERE p_name LIKE 'hot%' UNION ALL SELECT 'unheard of') w
LEFT JOIN (SELECT * FROM pop WHERE country = 'asia' AND period BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') p
  ON w.term = p.term"""
_RAW_POP = """
  SELECT p_partkey, p_name AS term, CASE WHEN p_partkey % 2 = 0 THEN 'us' ELSE 'gb' END AS country, p_type AS genre,
    CASE p_partkey % 3 WHEN 0 THEN DATE '2001-01-07' + (p_partkey % 4 * 7)::INT WHEN 1 THEN DATE '2001-02-01' END AS period,
    (p_partkey % 500 + 1)::INT AS rank_in_genre, p_size AS pop_1to100, (p_size % 5 + 1)::INT AS pop_1to5
  FROM part WHERE p_partkey % 10 <> 9"""
SQL["popularity_parse"] = f"""
SELECT term, country, genre, period, count(*) AS n, min(rank_in_genre) AS best_rank, max(pop_1to5) AS pop_1to5
FROM ({_RAW_POP}) GROUP BY 1, 2, 3, 4"""
SQL["popularity_upsert"] = f"""
SELECT term, country, genre, period, pop_1to100, (rank_in_genre // 24)::INT AS pulled_day FROM ({_RAW_POP})
QUALIFY row_number() OVER (PARTITION BY term, country, genre, period ORDER BY rank_in_genre DESC, pop_1to100 DESC) = 1"""


def _tails(source: str) -> str:
    """Rows of ``source`` (with a column term) that yield a tail."""
    best = ("list_reduce(list_prepend('', parts[2:]), lambda b1, b2: CASE WHEN b2 <> '' AND "
            "len(string_split(b2, ' ')) > CASE WHEN b1 = '' THEN 0 ELSE len(string_split(b1, ' ')) END THEN b2 ELSE b1 END)")
    return f"""
  SELECT * FROM (SELECT *, string_split(tail, ' ') AS ws FROM (
    SELECT *, {S.trim_filler(best)} AS tail FROM (SELECT *, {S.tail('term')} AS parts FROM ({source}))))
  WHERE len(parts) >= 2 AND tail <> '' AND NOT (len(ws) < 2 AND (tail IN {S.GENERIC} OR length(tail) < 4))
    AND len(list_filter(ws, lambda gw: gw NOT IN {S.GENERIC})) > 0 AND tail <> {S.trim_filler('parts[1]')}"""


SQL["descriptor_tails"] = f"""
SELECT tail, arg_min(term, page_id) AS origin, count(*) AS n FROM ({_tails('''
  SELECT page_id, lower(array_to_string(string_split(title, ' ')[1:2], ' ')
    || [' - ', ': ', ' – ', ', ', ' '][page_id % 5 + 1] || array_to_string(string_split(title, ' ')[3:], ' ')) AS term
  FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)''')}) GROUP BY 1"""
SQL["tail_candidates"] = f"""
SELECT tail, 'us' AS country, min(term) AS origin FROM ({_tails("SELECT lower(title) AS term FROM items")})
WHERE tail NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY 1 ORDER BY tail LIMIT 500"""

# --- text and lexicon -----------------------------------------------------------------------
SQL["term_normalize"] = f"""
SELECT lang, {S.norm('raw')} AS term, count(*) AS n
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS raw FROM documents) GROUP BY 1, 2"""
SQL["token_forms"] = f"""
SELECT token, {S.sing('token')} AS singular, n FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({S.toks('term')}) AS token FROM sugg_rows) GROUP BY 1)"""
SQL["term_flags"] = f"""
SELECT term, len(list_filter({S.toks('term')}, lambda hb: hb IN {S.HINTS})) > 0 AS brand_hint, {S.can_lead('term')} AS can_lead,
  NOT ({S.all_broad('term')}) AS can_link, {S.squash('term')} AS squashed, array_to_string({S.content('term')}, ' ') AS content
FROM (SELECT term FROM keywords UNION SELECT term FROM sugg_rows UNION SELECT term FROM titles)"""
SQL["seller_flags"] = f"SELECT track_id, {S.giant('seller')} AS giant, trim({S.head('title')}) AS head FROM items"
SQL["decode_suggestions"] = f"""
SELECT storefront, term, count(*) AS n, min(position)::INT AS position FROM (
  SELECT lang AS storefront, {S.norm('raw')} AS term, position FROM (
    SELECT lang, regexp_replace(l, '[\\\\"\\t\\r]', '', 'g') AS raw, position FROM (
      SELECT lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS position
      FROM documents WHERE doc_id % 5 <> 4)))
WHERE length(term) > 2 GROUP BY 1, 2"""
SQL["root_match"] = f"""
SELECT conv_id, turn, line::INT AS line, len(list_filter({S.toks('root')}, lambda rm: NOT list_contains({S.toks("replace(term, '-', ' ')")}, rm))) = 0 AS matches
FROM (SELECT conv_id, turn, line - 1 AS line, root, {S.norm('raw')} AS term FROM (
  SELECT conv_id, turn, split_part({S.norm('text')}, ' ', 1) AS root, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations))"""
_MATCHED = f"""(SELECT * FROM sugg_rows WHERE list_contains({S.toks("replace(term, '-', ' ')")}, prefix) OR prefix LIKE '%-%'
    AND len(list_filter({S.toks('prefix')}, lambda rm: NOT list_contains({S.toks("replace(term, '-', ' ')")}, rm))) = 0)"""
SQL["best_positions"] = f"SELECT storefront, term, min(position)::INT AS position FROM {_MATCHED} GROUP BY 1, 2"
SQL["harvest_objects"] = f"""
SELECT storefront, prefix, token, count(*) AS n FROM (
  SELECT storefront, prefix, {S.sing('raw')} AS token FROM (
    SELECT storefront, prefix, unnest({S.toks('term')}) AS raw FROM (SELECT DISTINCT storefront, prefix, term FROM {_MATCHED}))
  WHERE raw <> prefix AND raw NOT IN {S.STOP})
WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY 1, 2, 3"""


def _frequency(where: str = "true") -> str:
    return f"""
  SELECT storefront, token, count(*) AS n FROM (
    SELECT storefront, {S.sing('raw')} AS token FROM (
      SELECT storefront, unnest({S.toks('term')}) AS raw FROM sugg_rows WHERE {where}))
  WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN {S.STOP} GROUP BY 1, 2"""


def _verbs(extra: str = "") -> str:
    return f"""
  SELECT storefront{extra}, verb, count(DISTINCT term) AS n_terms FROM (
    SELECT storefront{extra}, term, {S.sing('prefix')} AS verb FROM (SELECT *, doc_id % 7 AS run_id FROM sugg_rows))
  WHERE verb NOT IN {S.STOP} AND verb NOT IN {SEEDS} AND length(verb) >= 3 GROUP BY ALL HAVING count(DISTINCT term) >= 2"""


_EVIDENCE = f"SELECT verb, count(DISTINCT run_id) AS evidence FROM ({_verbs(', run_id')}) GROUP BY 1"
SQL["token_frequency"] = _frequency()
SQL["discover_verbs"] = _verbs()
SQL["promotable_verbs"] = f"SELECT * FROM ({_EVIDENCE}) WHERE evidence >= 2"
SQL["probe_ledger"] = """
SELECT prefix, storefront, max(seen_at)::DATE AS probed_on, count(DISTINCT term) AS yield_count FROM sugg_rows s
WHERE seen_at = (SELECT max(seen_at) FROM sugg_rows t WHERE t.prefix = s.prefix AND t.storefront = s.storefront)
GROUP BY 1, 2"""
_LEDGER = "(SELECT prefix, max(seen_at) AS probed_at FROM sugg_rows GROUP BY 1)"
_FRONTIER = f"""
  SELECT token, n FROM (SELECT token, sum(n)::BIGINT AS n FROM ({_frequency()}) GROUP BY 1) WHERE n >= 2 AND token NOT IN {S.BROAD} AND token NOT IN {S.STOP}
    AND token NOT IN (SELECT prefix FROM {_LEDGER})"""
SQL["frontier_top"] = f"{_FRONTIER} ORDER BY n DESC, token LIMIT 50"
SQL["stalest_prefixes"] = f"""
SELECT prefix FROM (SELECT * FROM {_LEDGER} WHERE probed_at < TIMESTAMP '2024-02-08' ORDER BY probed_at, prefix LIMIT 30)"""
_PLACES = ", ".join(f"('{v}', {p})" for v, p in seed_order())
SQL["plan_roots"] = f"""
WITH pool AS (
  SELECT verb AS root, 1 AS tier, place::BIGINT AS place FROM (VALUES {_PLACES}) v(verb, place)
  UNION ALL SELECT verb, 2, -evidence FROM ({_EVIDENCE}) WHERE evidence >= 2
  UNION ALL SELECT token, 3, -n FROM ({_FRONTIER})
  UNION ALL SELECT prefix, 4, epoch(probed_at)::BIGINT FROM {_LEDGER} WHERE probed_at < TIMESTAMP '2024-04-08'),
filled AS (
  SELECT * FROM pool WHERE tier = 4 OR root NOT IN (SELECT prefix FROM {_LEDGER})
  QUALIFY row_number() OVER (PARTITION BY root ORDER BY tier, place) = 1),
cut AS (SELECT * FROM filled ORDER BY tier, place, root LIMIT 120)
SELECT * FROM cut WHERE root NOT IN {S.BROAD} OR (SELECT count(*) FROM cut WHERE tier = 1) >= 120
  OR ((SELECT count(*) FROM cut WHERE tier = 1) = 0 AND (SELECT count(*) FROM cut WHERE tier <= 3) < 120)"""
_SUFFIX = ", ".join(f"('{s}')" for s in probe_suffixes(True))
SQL["probe_prefixes"] = f"""
SELECT prefix AS root, prefix || suffix AS prefix FROM (SELECT DISTINCT prefix FROM sugg_rows), (VALUES {_SUFFIX}) s(suffix)"""
SQL["metadata_tokens"] = f"""
SELECT term, storefront, token, count(*) AS n FROM (
  SELECT term, storefront, {S.sing('raw')} AS token FROM (
    SELECT term, storefront, trim(unnest({S.toks("replace(replace(lower(title || ' ' || subtitle), ':', ' '), '-', ' ')")}), '.,!()&') AS raw
    FROM list_rows))
WHERE length(token) > 2 AND token NOT IN {S.STOP} GROUP BY 1, 2, 3"""
SQL["related_suggestions"] = """
SELECT 'en' AS storefront, token, suggestion, position::INT AS position, (row_number() OVER (PARTITION BY token ORDER BY position, suggestion))::INT AS place
FROM (SELECT DISTINCT split_part(term, ' ', 1) AS token FROM titles WHERE term <> '')
JOIN (SELECT term AS suggestion, min(position) AS position FROM sugg_rows WHERE storefront = 'en' GROUP BY 1)
  ON contains(suggestion, token) QUALIFY place <= 30"""

# --- features, gates, score, rating ---------------------------------------------------------
_ROWTEXT = "lower(coalesce(title, '') || ' ' || coalesce(subtitle, ''))"
_QUERY = f"list_distinct({S.content('term')})"
_FEATURES = f"""
  SELECT term, storefront, any_value(suggest_pos) AS suggest_pos, any_value(status) AS status, any_value(source) AS source,
    any_value(first_seen) AS first_seen, any_value(first_part) AS first_part,
    median(rating) FILTER (pos <= 3) AS top3_rating_median,
    floor(median(rating_count) FILTER (pos <= 3))::BIGINT AS top3_reviews_median,
    (max(rating_count) FILTER (pos = 1))::BIGINT AS top1_reviews,
    avg((coalesce(days_since_update, 0) > 365)::INT) AS stale_share,
    avg((coalesce(rating, 0) < 4.2)::INT) AS weak_share,
    avg((rating_count < 2000)::INT) AS thin_share,
    (min(age_days) FILTER (pos <= 5))::INT AS youngest_top5_age_days,
    avg((lower(lang1) <> lang AND lower(lang2) <> lang)::INT) FILTER (pos <= 5) AS no_localization_share,
    avg((primary_genre = 'Games' OR genre2 = 'Games')::INT) AS games_share,
    max(seller) FILTER (pos = 1) AS top1_seller, max(title) FILTER (pos = 1) AS leader_title,
    max(rating) FILTER (pos = 1) AS leader_rating, max(track_id) FILTER (pos = 1) AS leader_id,
    max({_ROWTEXT}) FILTER (pos = 1) AS leader_text,
    (sum((price > 0)::INT))::INT AS monetized_count, (sum((price > 0)::INT))::INT AS paid_count,
    avg((n_hit >= greatest(1, n_query - 1))::INT) AS coherence, avg(any_hit::INT) AS in_metadata_share
  FROM (SELECT *, len(list_intersect(query, hay)) AS n_hit, len(query) AS n_query FROM (
    SELECT *, {_QUERY} AS query, {S.sings(S.toks(_ROWTEXT))} AS hay,
      len(list_intersect({S.toks('term')}, {S.toks(_ROWTEXT)})) > 0 AS any_hit
    FROM list_rows JOIN kw_lang USING (term, storefront)))
  GROUP BY term, storefront"""
_sa, _sb, _common, _ra, _rb = S.token_set("a", "b")


def _token_set(source: str, key: str) -> str:
    """Token-set ratio of columns a and b of ``source``."""
    return f"""
  SELECT {key}, CASE WHEN na = 0 OR nb = 0 THEN 0.0
      WHEN lc > 0 AND (ra = '' OR rb = '') THEN 100.0
      WHEN lc > 0 THEN greatest(score, 100 - 100 * (1 + la)::DOUBLE / (2 * lc + 1 + la), 100 - 100 * (1 + lb)::DOUBLE / (2 * lc + 1 + lb))
      ELSE score END AS ratio
  FROM (SELECT *, 100 - 100 * (la + lb - 2 * CASE WHEN ra = '' OR rb = '' THEN 0 ELSE {S.lcs('ra', 'rb')} END)::DOUBLE
          / greatest(2 * lc + la + lb + CASE WHEN lc > 0 THEN 2 ELSE 0 END, 1) AS score
        FROM (SELECT *, length(ra) AS la, length(rb) AS lb, length(array_to_string(common, ' ')) AS lc FROM (
          SELECT {key}, len({_sa}) AS na, len({_sb}) AS nb, {_common} AS common, {_ra} AS ra, {_rb} AS rb FROM ({source}))))"""


_SIMILAR = f"""
  SELECT term, storefront, {S.name_match('term', 'leader_title')} AS top1_name_match, ratio / 100 AS top1_relevance
  FROM ({_FEATURES}) JOIN ({_token_set(f"SELECT term, storefront, term AS a, leader_text AS b FROM ({_FEATURES})", "term, storefront")})
  USING (term, storefront)"""
_b.CTES["features"] = _FEATURES
_b.CTES["sims"] = _SIMILAR.replace(f"({_FEATURES})", "features")
_b.CTES["factors"] = f"""
  SELECT *, {S.half_up("stale_share * 0.30::DOUBLE + weak_share * 0.20::DOUBLE + thin_share * 0.20::DOUBLE + no_localization_share * 0.15::DOUBLE + (1.0::DOUBLE - least(top1_relevance, 1.0::DOUBLE)) * 0.15::DOUBLE", 3)} AS weakness,
    {S.half_up("CASE WHEN top1_reviews <= 300 THEN 0.0 WHEN top1_reviews <= 30000 THEN (log10(top1_reviews) - log10(300)) / (log10(30000) - log10(300)) ELSE greatest(0.0, (log10(1000000) - log10(top1_reviews)) / (log10(1000000) - log10(30000))) END", 3)} AS market,
    {S.half_up("0.55::DOUBLE * CASE WHEN suggest_pos IS NULL THEN 0.35::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (suggest_pos - 1)::DOUBLE / 10.0::DOUBLE) END + 0.45::DOUBLE * least(in_metadata_share * 1.5::DOUBLE, 1.0::DOUBLE)", 3)} AS demand_proxy,
    {S.half_up("least(coherence * 1.5::DOUBLE, 1.0::DOUBLE)", 3)} AS coherence_factor,
    array_to_string(list_filter([
      CASE WHEN top1_reviews = 0 AND coherence = 0 THEN 'empty_serp' END, CASE WHEN coherence < 0.25 THEN 'incoherent' END,
      CASE WHEN top1_reviews < 300 THEN 'no_traction' END, CASE WHEN games_share >= 0.5 THEN 'game_dominated' END,
      CASE WHEN {S.giant('top1_seller')} THEN 'giant_dominated' END, CASE WHEN top1_reviews >= 1000000 THEN 'fortress' END,
      CASE WHEN top3_rating_median >= 4.4 AND top3_reviews_median >= 50000 THEN 'unbeatable_top3' END],
      lambda fg: fg IS NOT NULL), ',') AS gates_failed
  FROM features JOIN sims USING (term, storefront)"""
_b.CTES["scored"] = f"""
  SELECT *, CASE WHEN status IN ('in_astro', 'go', 'no_go', 'narrow', 'hold') THEN status ELSE verdict END AS status_after,
    array_to_string(list_concat(CASE WHEN len(crossed) > 0 THEN crossed ELSE [lead] END,
      CASE WHEN verdict = 'watchlist' THEN ['{L.NOTE_WATCH}'] ELSE [] END), '; ') AS notes
  FROM (SELECT *, {S.half_up("sqrt(weakness * market * demand_proxy * coherence_factor) * 100", 1)} AS score,
    CASE gates_failed WHEN '' THEN 'queued' WHEN 'unbeatable_top3' THEN 'watchlist' ELSE 'rejected' END AS verdict,
    list_filter([
      CASE WHEN stale_share >= 0.5 THEN floor(stale_share * 10)::INT || '{L.NOTE_STALE}' END,
      CASE WHEN no_localization_share >= 0.6 THEN floor(no_localization_share * 5)::INT || '{L.NOTE_NO_LOCAL}' END,
      CASE WHEN top1_relevance < 0.5 THEN '{L.NOTE_IRRELEVANT}' END,
      CASE WHEN top3_reviews_median < 2000 THEN '{L.NOTE_THIN}' END,
      CASE WHEN paid_count > 0 THEN paid_count || '{L.NOTE_PAID}' END], lambda cn: cn IS NOT NULL) AS crossed,
    CASE greatest(weakness, market, demand_proxy, coherence_factor)
      WHEN weakness THEN '{L.LEADING_FACTOR["weakness"]} (ведущий фактор: weakness ' || weakness || ')'
      WHEN market THEN '{L.LEADING_FACTOR["market"]} (ведущий фактор: market ' || market || ')'
      WHEN demand_proxy THEN '{L.LEADING_FACTOR["demand_proxy"]} (ведущий фактор: demand_proxy ' || demand_proxy || ')'
      ELSE '{L.LEADING_FACTOR["coherence"]} (ведущий фактор: coherence ' || coherence_factor || ')' END AS lead
  FROM factors)"""


def _r6(*columns: str) -> str:
    return ", ".join(f"{S.half_up(c, 6)} AS {c}" for c in columns)


SQL["list_features"] = f"""
SELECT term, storefront, {_r6('top3_rating_median')}, top3_reviews_median, top1_reviews,
  {_r6('stale_share', 'weak_share', 'thin_share')}, youngest_top5_age_days, {_r6('no_localization_share', 'games_share')},
  top1_seller, monetized_count, paid_count, {_r6('coherence', 'in_metadata_share')} FROM features"""
SQL["leader_similarity"] = f"SELECT term, storefront, {_r6('top1_name_match', 'top1_relevance')} FROM sims"
SQL["fingerprints"] = """
SELECT term, storefront, coalesce(string_agg(track_id::VARCHAR, ',' ORDER BY track_id) FILTER (track_id <> 0), '') AS items,
  max(track_id) FILTER (pos = 1) AS leader FROM list_rows GROUP BY 1, 2"""
SQL["failed_gates"] = "SELECT term, storefront, gates_failed, verdict FROM scored"
SQL["niche_score"] = """
SELECT term, storefront, weakness, market, demand_proxy, coherence_factor, score, verdict, notes FROM scored"""


def _rated(source: str) -> str:
    """Stars, flags, missing and reason of rows with features, similarities and cluster_size."""
    return f"""
  SELECT *, greatest(1, least(5, (demand::INT + room::INT + sized::INT + clustered::INT + clean::INT))) AS stars,
    array_to_string(list_filter([CASE WHEN NOT demand THEN '{L.SIGNAL_DEMAND}' END, CASE WHEN NOT room THEN '{L.SIGNAL_ROOM}' END,
      CASE WHEN NOT sized THEN '{L.SIGNAL_MARKET}' END, CASE WHEN NOT clustered THEN '{L.SIGNAL_CLUSTER}' END,
      CASE WHEN NOT clean THEN '{L.SIGNAL_CLEAN}' END], lambda mi: mi IS NOT NULL), ', ') AS missing,
    array_to_string(list_filter([CASE WHEN top1_name_match >= 0.75 THEN '{L.FLAG_BRAND}' END,
      CASE WHEN stale_share >= 0.5 THEN '{L.FLAG_STALE}' END], lambda fl: fl IS NOT NULL), ' ') AS flags
  FROM (SELECT *, coalesce(suggest_pos <= 3, false) OR in_metadata_share >= 0.5 AS demand,
      stale_share >= 0.4 OR top1_relevance < 0.6 AS room, top1_reviews BETWEEN 3000 AND 300000 AS sized,
      cluster_size >= 2 AS clustered, coherence >= 0.5 OR no_localization_share >= 0.6 AS clean FROM ({source}))"""


SQL["star_rating"] = f"""
SELECT term, storefront, stars, flags, missing,
  CASE WHEN told = '' THEN 'нет сильных признаков' ELSE told END || CASE WHEN missing = '' THEN '' ELSE ' · не хватает: ' || missing END AS reason
FROM (SELECT *, array_to_string(list_filter([
    CASE WHEN demand THEN '{L.SIGNAL_DEMAND}: ' || CASE WHEN suggest_pos IS NOT NULL THEN 'автокомплит #' || suggest_pos
      ELSE 'в метаданных у ' || round_even(in_metadata_share * 10, 0)::INT || '/10' END END,
    CASE WHEN room THEN '{L.SIGNAL_ROOM}: ' || round_even(stale_share * 10, 0)::INT || '/10 заброшены' || CASE WHEN top1_relevance < 0.6 THEN ', точного лидера нет' ELSE '' END END,
    CASE WHEN sized THEN '{L.SIGNAL_MARKET}: ' || top1_reviews // 1000 || 'k отзывов у лидера' END,
    CASE WHEN clustered THEN '{L.SIGNAL_CLUSTER}: ' || cluster_size || ' запросов' END,
    CASE WHEN clean THEN '{L.SIGNAL_CLEAN}: связность ' || round_even(coherence * 100, 0)::INT || '%' END], lambda te: te IS NOT NULL), ', ') AS told
  FROM ({_rated("SELECT *, coalesce(suggest_pos, 1) % 3 AS cluster_size FROM features JOIN sims USING (term, storefront)")}))"""
SQL["rescore_changes"] = "SELECT status, status_after, count(*) AS n FROM scored GROUP BY 1, 2"
SQL["rescore_promoted"] = """
SELECT term, storefront, status, score FROM scored WHERE status_after = 'queued' AND status <> 'queued'"""
SQL["gate_counts"] = """
SELECT 'gate' AS kind, name, count(*) AS n FROM (SELECT unnest(string_split(gates_failed, ',')) AS name FROM scored WHERE gates_failed <> '')
GROUP BY 1, 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM scored GROUP BY 1, 2"""
SQL["flatten_apps"] = """
SELECT s_suppkey AS track_id, 'com.example.a' || s_suppkey AS bundle_id, s_name AS title, 'Line one of ' || s_name AS subtitle,
  s_name AS seller, 'Utilities,Tools' AS genres, 'Utilities' AS primary_genre,
  CASE WHEN s_suppkey % 3 <> 0 THEN floor(abs(s_acctbal) / 100) / 25.0::DOUBLE END AS rating,
  CASE WHEN s_suppkey % 4 <> 0 THEN floor(abs(s_acctbal))::BIGINT ELSE 0 END AS rating_count,
  CASE s_suppkey % 5 WHEN 0 THEN 0.99::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS price, s_suppkey % 5 = 0 AS is_paid,
  s_suppkey % 2 = 0 AS has_iap, s_suppkey % 5 = 0 AS is_monetized,
  CASE WHEN s_suppkey % 10 <> 9 THEN date_diff('day', DATE '1999-01-01' + (s_suppkey * 7 % 1000)::INT, DATE '2002-01-01')::INT END AS days_since_update,
  date_diff('day', DATE '1999-01-01' + (s_suppkey * 3 % 1000)::INT, DATE '2002-01-01')::INT AS age_days,
  'EN' AS languages, '4+' AS content_rating FROM supplier"""
SQL["enrich_outcomes"] = """
SELECT storefront, CASE WHEN storefront = 'zz' THEN 'unknown_store' WHEN listed AND first_part % 5 = 0 THEN 'already_had_list'
    WHEN NOT listed OR first_part % 3 = 0 THEN 'empty_list' WHEN top1_name_match >= 0.75 THEN 'brand' ELSE verdict END AS outcome, count(*) AS n
FROM (SELECT k.term, k.storefront, k.first_part, s.term IS NOT NULL AS listed, top1_name_match, verdict
      FROM keywords k LEFT JOIN scored s ON k.term = s.term AND k.storefront = s.storefront) GROUP BY 1, 2"""
SQL["tracked_items"] = """
SELECT DISTINCT storefront, track_id FROM list_rows JOIN keywords USING (term, storefront)
WHERE pos <= 3 AND track_id <> 0 AND status IN ('queued', 'watchlist', 'in_astro')"""
SQL["name_matches"] = f"SELECT page_id, {S.half_up(S.name_match('term', 'title'), 6)} AS match FROM titles"
_FIRST = f"""
  SELECT DISTINCT name, lower(name) AS low, title, seller FROM (
    SELECT CASE WHEN track_id % 2 = 0 THEN split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) ELSE split_part(title, ' ', 1) END AS name,
      title, seller FROM list_rows JOIN kw_lang USING (term, storefront) WHERE pos = 1)"""
_plain = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'))"
SQL["brand_signals"] = f"""
SELECT name, title, CASE WHEN {S.name_match('low', 'title')} >= 0.75 THEN '{L.BRAND_BY_TITLE}'
  WHEN {S.name_match('low', 'seller')} >= 0.75 THEN '{L.BRAND_BY_SELLER}'
  WHEN len({S.toks(_plain('low'))}) = 1 AND split_part({_plain('title')}, ' ', 1) = {_plain('low')} THEN '{L.BRAND_BY_FIRST_WORD}' ELSE '' END AS why
FROM ({_FIRST})"""
SQL["token_set_relevance"] = f"""
SELECT page_id, {S.half_up('ratio', 4)} AS ratio FROM ({_token_set("SELECT page_id, lower(term) AS a, lower(title) AS b FROM titles", "page_id")})"""

# --- series ---------------------------------------------------------------------------------
SQL["metric_upsert"] = """
SELECT user_id AS track_id, 'us' AS storefront, ts::DATE AS day, value AS rating, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1"""
SQL["app_dimension"] = """
SELECT l_suppkey AS track_id, 'us' AS storefront,
  arg_max('title ' || l_partkey, (l_shipdate::DATE, l_orderkey, l_linenumber, 'title ' || l_partkey)) AS title,
  arg_min('genre ' || l_linenumber, (l_shipdate::DATE, l_orderkey, l_linenumber, 'genre ' || l_linenumber)) AS primary_genre,
  max(l_shipdate)::DATE AS updated_at FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1"""
_NEWEST = lambda rows, key, order, n: (
    f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM {rows} QUALIFY place <= {n})")
SQL["review_delta"] = f"""
SELECT track_id, storefront, weekly AS weekly_review_delta, trunc(weekly * 45 * 4.33::DOUBLE)::BIGINT AS est_monthly_installs FROM (
  SELECT track_id, storefront, CASE WHEN count(*) >= 2 AND max(day) - min(day) >= 2 THEN
    trunc((arg_max(rating_count, day) - arg_min(rating_count, day))::DOUBLE / (max(day) - min(day)) * 7)::BIGINT END AS weekly
  FROM {_NEWEST('metrics', 'track_id, storefront', 'day DESC', 20)} GROUP BY 1, 2)"""


def _direction(old: str, new: str) -> str:
    return (f"CASE WHEN {old} <= 0 THEN CASE WHEN {new} <= 0 THEN '{L.FLAT}' ELSE '{L.UP}' END "
            f"WHEN ({new} - {old}) / abs({old}) > 0.15 THEN '{L.UP}' WHEN ({new} - {old}) / abs({old}) < -0.15 THEN '{L.DOWN}' "
            f"ELSE '{L.FLAT}' END")


_TRAFFIC = f"""
  SELECT track_id, storefront, CASE WHEN vn IS NULL THEN '{L.NONE}' ELSE {_direction('vo', 'vn')} END AS arrow,
    CASE WHEN vo > 0 THEN CASE WHEN (vn - vo) / vo * 100 < 0 THEN '-' ELSE '+' END || floor(abs((vn - vo) / vo * 100) + 0.5)::BIGINT || '%' END AS label,
    {S.half_up('vo', 3)} AS velocity_old, {S.half_up('vn', 3)} AS velocity_new
  FROM (SELECT track_id, storefront,
      CASE WHEN known THEN gain_n::DOUBLE / span_n END AS vn, CASE WHEN known THEN gain_o::DOUBLE / span_o END AS vo
    FROM (SELECT track_id, storefront,
        arg_max(rating_count, day) FILTER (age < 7) - arg_min(rating_count, day) FILTER (age < 7) AS gain_n,
        max(day) FILTER (age < 7) - min(day) FILTER (age < 7) AS span_n,
        arg_max(rating_count, day) FILTER (age BETWEEN 7 AND 14) - arg_min(rating_count, day) FILTER (age BETWEEN 7 AND 14) AS gain_o,
        max(day) FILTER (age BETWEEN 7 AND 14) - min(day) FILTER (age BETWEEN 7 AND 14) AS span_o,
        coalesce(count(*) >= 4 AND count(*) FILTER (age < 7) >= 2 AND count(*) FILTER (age BETWEEN 7 AND 14) >= 2
          AND span_n > 0 AND span_o > 0, false) AS known
      FROM (SELECT *, max(day) OVER (PARTITION BY track_id, storefront) - day AS age
            FROM {_NEWEST('metrics', 'track_id, storefront', 'day DESC', 40)}) GROUP BY 1, 2))"""
_DEMAND = f"""
  SELECT term, storefront, CASE WHEN NOT known THEN '{L.NONE}' WHEN new_position = old_position THEN '{L.FLAT}'
      WHEN new_position < old_position THEN '{L.UP}' ELSE '{L.DOWN}' END AS arrow, old_position::INT AS old_position, new_position::INT AS new_position,
    CASE WHEN known AND new_position <> old_position THEN '#' || new_position END AS label
  FROM (SELECT term, storefront, count(*) >= 2 AND max(seen_at) <> min(seen_at) AS known,
      arg_min(position, place) AS new_position, arg_max(position, place) AS old_position
    FROM {_NEWEST('sugg_rows', 'term, storefront', 'seen_at DESC, position', 20)} GROUP BY 1, 2)"""
SQL["traffic_trend"] = _TRAFFIC
SQL["demand_trend"] = _DEMAND
SQL["score_trend"] = f"""
SELECT term, storefront, CASE WHEN n < 2 THEN '{L.NONE}' WHEN abs(new_score - old_score) < 3 THEN '{L.FLAT}'
    WHEN new_score > old_score THEN '{L.UP}' ELSE '{L.DOWN}' END AS arrow, {S.half_up('old_score', 6)} AS old_score, {S.half_up('new_score', 6)} AS new_score
FROM (SELECT term, storefront, count(*) AS n, arg_min(score, place) AS new_score, arg_max(score, place) AS old_score
  FROM (SELECT *, row_number() OVER (PARTITION BY term, storefront ORDER BY scored_at DESC) AS place FROM (
    SELECT o_orderpriority AS term, (o_custkey % 50)::VARCHAR AS storefront, date_trunc('year', o_orderdate) AS scored_at,
      (count(*) FILTER (o_totalprice > 250000)) * 100.0::DOUBLE / count(*) AS score FROM orders GROUP BY 1, 2, 3) QUALIFY place <= 5)
  GROUP BY 1, 2)"""
SQL["decay_alerts"] = """
SELECT track_id, storefront, c_name AS title, readings, rating_first, rating_last FROM (
  SELECT track_id, storefront, count(*) AS readings, arg_min(rating, day) AS rating_first, arg_max(rating, day) AS rating_last
  FROM metrics WHERE day >= DATE '2024-01-31' - 20 GROUP BY 1, 2)
JOIN customer ON track_id = c_custkey
WHERE readings >= 3 AND rating_first <> 0 AND rating_last <> 0 AND rating_first - rating_last >= 0.1::DOUBLE"""
SQL["history_length"] = """
SELECT greatest(date_diff('day', min(ts)::DATE, DATE '2024-03-05'), 0)::INT AS history_days,
  (greatest(date_diff('day', min(ts)::DATE, DATE '2024-03-05'), 0) // 7)::INT AS history_weeks FROM events"""
SQL["leader_series"] = """
SELECT term, l.storefront, l.track_id, count(*) AS n_days, max(m.rating_count) AS rating_count
FROM (SELECT term, storefront, track_id FROM list_rows WHERE pos = 1) l
JOIN metrics m ON l.track_id = m.track_id AND l.storefront = m.storefront GROUP BY 1, 2, 3"""
SQL["chosen_trend"] = f"""
SELECT k.term, k.storefront, coalesce(nullif(d.arrow, '{L.NONE}'), nullif(t.arrow, '{L.NONE}'), '{L.NONE}') AS trend
FROM (SELECT term, storefront, min(doc_id) AS leader_id FROM sugg_rows GROUP BY 1, 2) k
LEFT JOIN ({_DEMAND}) d ON k.term = d.term AND k.storefront = d.storefront LEFT JOIN ({_TRAFFIC}) t ON k.leader_id = t.track_id"""

# --- lifecycle ------------------------------------------------------------------------------
SQL["keyword_upsert"] = """
SELECT term, storefront, arg_min(CASE WHEN doc_id % 2 = 0 THEN 'suggest' ELSE 'asa' END, (seen_at, doc_id, line)) AS source,
  (min(position) FILTER (line % 4 <> 0))::INT AS suggest_pos, min(seen_at)::DATE AS first_seen, max(seen_at)::DATE AS last_seen
FROM sugg_rows GROUP BY 1, 2"""
SQL["decision_log"] = """
SELECT CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'accepted' END AS kind,
  CASE WHEN event_id % 10 = 0 THEN 'maybe' ELSE verdict END AS verdict, count(*) AS n FROM decisions
WHERE event_id % 10 = 0 OR term IN (SELECT term FROM keywords WHERE status IN ('queued', 'watchlist')) GROUP BY 1, 2"""


def _hidden(days: int, cleared: str = "") -> str:
    log = "SELECT term, verdict, decided_at FROM decisions" + (f" UNION ALL {cleared}" if cleared else "")
    return f"""
  SELECT term, verdict FROM (SELECT * FROM ({log})
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY decided_at DESC, verdict DESC) = 1)
  WHERE verdict <> 'clear' AND NOT (verdict = 'later' AND decided_at < TIMESTAMP '2024-01-31' - to_days({days}))"""


_HIDDEN = _hidden(1)
SQL["hidden_terms"] = _HIDDEN
SQL["decision_undo"] = _hidden(1, "SELECT DISTINCT term, 'clear', TIMESTAMP '2024-01-30' FROM keywords WHERE source = 'asa'")
SQL["decision_summary"] = "SELECT verdict, count(DISTINCT term) AS n_terms FROM decisions GROUP BY 1"
SQL["reviewed_list"] = f"""
SELECT h.term, h.verdict, n_terms FROM ({_hidden(14)}) h
JOIN (SELECT verdict, count(DISTINCT term) AS n_terms FROM decisions GROUP BY 1) USING (verdict)"""
SQL["facts_load"] = """
SELECT term, storefront, CASE WHEN status IN ('queued', 'new') AND (term, storefront) IN (
  SELECT (term, storefront) FROM kw_text WHERE p_size >= 25) THEN 'in_astro' ELSE status END AS status FROM keywords"""
SQL["facts_projection"] = """
SELECT term, storefront, count(*) AS n, max(p_size)::DOUBLE AS popularity, min(p_partkey % 100)::DOUBLE AS difficulty,
  0::BIGINT AS n_ranked FROM kw_text GROUP BY 1, 2"""
SQL["verdict_replies"] = "SELECT term, storefront, accepted, category, intent, confidence, niche_name, note FROM verdicts"
SQL["verdict_defaults"] = """
SELECT term, storefront, CASE WHEN length(term) % 3 <> 0 THEN category ELSE 'niche' END AS category, intent, 'unclear' AS monetization,
  CASE WHEN length(term) % 2 = 0 THEN niche_name ELSE term END AS niche_name,
  CASE WHEN length(term) % 5 <> 0 THEN confidence ELSE 0.0::DOUBLE END AS confidence, note FROM verdicts WHERE accepted"""
SQL["proposal_replies"] = "SELECT source_term, storefront, place::INT AS place, query, why FROM ideas"
SQL["proposal_exclusions"] = f"""
SELECT DISTINCT query, 'us' AS storefront FROM ideas WHERE query NOT IN (SELECT term FROM titles) AND query NOT IN (
  SELECT {S.norm('sentence')} FROM (SELECT unnest(string_split_regex(text, '[.\\n]')) AS sentence FROM conversations))"""
SQL["proposal_inserts"] = """
SELECT query, storefront, source_term, why,
  CASE WHEN length(query) % 2 <> 0 THEN 'pending' WHEN length(query) > 12 THEN 'accepted' ELSE 'no_demand' END AS status,
  CASE WHEN length(query) % 2 = 0 THEN why END AS note
FROM ideas QUALIFY row_number() OVER (PARTITION BY query ORDER BY place, source_term) = 1"""
_b.CTES["checked"] = f"""
  SELECT query, storefront, first_doc, coalesce(n_suggestions, 0) AS n_suggestions, demand_position::INT AS demand_position
  FROM proposals LEFT JOIN (
    SELECT storefront, prefix AS query, count(*) AS n_suggestions, min(position) FILTER (starts_with(term, prefix)) AS demand_position
    FROM (SELECT storefront, term, position, CASE WHEN doc_id % 3 <> 0 THEN array_to_string({S.toks('term')}[1:2], ' ') ELSE term END AS prefix
          FROM sugg_rows) GROUP BY 1, 2) USING (storefront, query)"""
_VERIFIED = """
  SELECT query, c.storefront, CASE WHEN demand_position IS NULL THEN 'no_demand' WHEN s.term IS NULL THEN 'incoherent'
    WHEN s.verdict = 'rejected' THEN 'gated' ELSE 'accepted' END AS status
  FROM checked c LEFT JOIN kw_text k ON first_doc = p_partkey LEFT JOIN scored s ON s.term = k.term AND s.storefront = k.storefront"""
SQL["demand_check"] = "SELECT query, storefront, n_suggestions, demand_position FROM checked"
SQL["proposal_verification"] = _VERIFIED
SQL["proposal_hit_rate"] = f"""
SELECT status, count(*) AS n, {S.half_up('count(*)::DOUBLE / sum(count(*)) OVER ()', 6)} AS share FROM ({_VERIFIED}) GROUP BY 1"""


def _related(seeds: str, excluded: str, limit: int) -> str:
    return f"""
  SELECT term, storefront, query, (row_number() OVER (PARTITION BY term, storefront ORDER BY query))::INT AS place
  FROM (SELECT DISTINCT s.term, s.storefront, query FROM (SELECT term, storefront, unnest({S.toks('term')}) AS word FROM ({seeds})) s
        JOIN ({excluded}) e ON s.storefront = e.storefront AND contains(query, word)) QUALIFY place <= {limit}"""


SQL["related_exclusions"] = _related(
    "SELECT DISTINCT split_part(term, ' ', 2) AS term, storefront FROM keywords WHERE suggest_pos <= 2",
    "SELECT term AS query, storefront FROM keywords", 40)
SQL["generator_input"] = f"""
WITH avoid AS (SELECT term, storefront, string_agg(query, ', ' ORDER BY place) AS avoid FROM ({_related(
    "SELECT term, storefront FROM kw_lang WHERE suggest_pos = 1",
    "SELECT term AS query, storefront FROM keywords WHERE source = 'asa'", 5)}) GROUP BY 1, 2)
SELECT k.term, k.storefront, 'Known niche: "' || k.term || '"' || chr(10) || 'Storefront: ' || upper(k.storefront) || chr(10)
  || string_agg('  - "' || substr(title, 1, 60) || '"', chr(10) ORDER BY pos)
  || coalesce(chr(10) || 'Already known, do not repeat: ' || any_value(avoid), '') AS model_input
FROM kw_lang k JOIN list_rows USING (term, storefront) LEFT JOIN avoid USING (term, storefront)
WHERE suggest_pos = 1 AND pos <= 5 GROUP BY 1, 2"""
SQL["labelled_lists"] = """
SELECT 'q' || doc_id AS query, CASE WHEN quality = 1 THEN 'niche' ELSE 'junk' END AS expected, title, seller, rating::DOUBLE AS rating, rating_count
FROM documents JOIN labels USING (doc_id), LATERAL (VALUES
  (source, lang, 4.5, n_chars * 11), ('Another App', 'Someone Else', 4.2, greatest(n_chars * 11 // 20, 100)),
  ('Third Option', 'Third Dev', 4.0, greatest(n_chars * 11 // 60, 50))) v(title, seller, rating, rating_count)"""
SQL["classifier_evaluation"] = """
WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'brand' WHEN quality = 1 THEN 'niche' ELSE 'junk' END AS expected,
    CASE WHEN n_chars % 7 = 0 THEN 'brand' WHEN n_chars > 300 THEN 'niche' ELSE 'junk' END AS got
  FROM documents JOIN labels USING (doc_id))
SELECT expected, count(*) AS n_cases, count(*) FILTER (expected = got) AS n_hits, NULL::BIGINT AS n_majority, NULL AS conclusion
FROM r GROUP BY 1
UNION ALL SELECT '(all)', count(*), count(*) FILTER (expected = got), count(*) FILTER (expected = 'niche'),
  CASE WHEN count(*) FILTER (expected = got) <= count(*) FILTER (expected = 'niche') THEN 'no better than the majority class'
       WHEN count(*) FILTER (expected = got) >= count(*) * 0.8 THEN 'separates the classes' ELSE 'partly useful' END FROM r"""
SQL["job_state"] = """
SELECT event_type AS key, arg_max(event_id::VARCHAR, (ts, event_id)) AS value FROM events GROUP BY 1"""
SQL["external_times"] = """
SELECT o_orderkey, (TIMESTAMP '2001-01-01' + to_hours(o_orderkey))::DATE AS day FROM orders"""

# --- similarity and graph --------------------------------------------------------------------


def _pairs(rows: str) -> str:
    return f"""
  SELECT p.storefront, a, b, n_common, n_common::DOUBLE / least(sa.size, sb.size) AS overlap,
    coalesce(la.track_id = lb.track_id, false) AS same_leader
  FROM (SELECT x.storefront, x.term AS a, y.term AS b, count(*) AS n_common
        FROM (SELECT DISTINCT storefront, term, track_id FROM {rows} WHERE track_id <> 0) x
        JOIN (SELECT DISTINCT storefront, term, track_id FROM {rows} WHERE track_id <> 0) y
          ON x.storefront = y.storefront AND x.track_id = y.track_id AND x.term < y.term GROUP BY 1, 2, 3) p
  JOIN (SELECT storefront, term, count(DISTINCT track_id) AS size FROM {rows} WHERE track_id <> 0 GROUP BY 1, 2) sa
    ON sa.storefront = p.storefront AND sa.term = a
  JOIN (SELECT storefront, term, count(DISTINCT track_id) AS size FROM {rows} WHERE track_id <> 0 GROUP BY 1, 2) sb
    ON sb.storefront = p.storefront AND sb.term = b
  JOIN (SELECT * FROM {rows} WHERE pos = 1) la ON la.storefront = p.storefront AND la.term = a
  JOIN (SELECT * FROM {rows} WHERE pos = 1) lb ON lb.storefront = p.storefront AND lb.term = b
  WHERE NOT ({S.all_broad('a')}) AND NOT ({S.all_broad('b')})
    AND (n_common::DOUBLE / least(sa.size, sb.size) >= 0.6 OR (la.track_id = lb.track_id AND n_common::DOUBLE / least(sa.size, sb.size) >= 0.3))"""


def _cluster_ctes(name: str, rows: str) -> None:
    """CTEs <name>_pairs, <name>_both, <name>_reach, <name>_members over ranked rows."""
    _b.CTES[f"{name}_pairs"] = _pairs(rows)
    _b.CTES[f"{name}_both"] = (f"SELECT storefront, a, b FROM {name}_pairs UNION SELECT storefront, b, a FROM {name}_pairs "
                               f"UNION SELECT storefront, a, a FROM {name}_pairs UNION SELECT storefront, b, b FROM {name}_pairs")
    _b.CTES[f"{name}_reach"] = f"""
  SELECT storefront, a AS term, b AS other FROM {name}_both
  UNION SELECT r.storefront, r.term, p.b FROM {name}_reach r JOIN {name}_both p ON r.storefront = p.storefront AND p.a = r.other"""
    _b.RECURSIVE.add(f"{name}_reach")
    _b.CTES[f"{name}_members"] = f"""
  SELECT t.storefront, t.term, coalesce(root, t.term) AS cluster_id FROM (SELECT DISTINCT storefront, term FROM {rows}) t
  LEFT JOIN (SELECT storefront, term, min(other) AS root FROM {name}_reach GROUP BY 1, 2) r USING (storefront, term)"""


_cluster_ctes("doc", "doc_rows")
_cluster_ctes("lst", "list_rows")
_cluster_ctes("crowd", "crowd_rows")


def _folded_pairs(pairs: str, rows: str) -> str:
    """Pairs of first terms of distinct lists, and of each copy with its first term."""
    return f"""
WITH lists AS (SELECT storefront, term, min(term) OVER (PARTITION BY storefront, items, leader) AS first_term FROM (
  SELECT storefront, term, list_sort(list_distinct(list(track_id) FILTER (track_id <> 0))) AS items,
    max(track_id) FILTER (pos = 1) AS leader FROM {rows} GROUP BY 1, 2))
SELECT p.storefront, a, b, n_common::INT AS n_common, {S.half_up('overlap', 6)} AS overlap, same_leader FROM {pairs} p
JOIN lists x ON x.storefront = p.storefront AND x.term = a JOIN lists y ON y.storefront = p.storefront AND y.term = b
WHERE (x.first_term = a AND y.first_term = b) OR (x.first_term = a AND y.first_term = a)"""


SQL["overlap_pairs"] = _folded_pairs("doc_pairs", "doc_rows")
SQL["overlap_pairs_of_lists"] = _folded_pairs("lst_pairs", "list_rows")
SQL["overlap_clusters"] = "SELECT storefront, term, cluster_id FROM doc_members"
SQL["crowd_clusters"] = "SELECT storefront, term, cluster_id FROM crowd_members"
SQL["cluster_heads"] = f"""
SELECT storefront, cluster_id, term AS head, n_members FROM (
  SELECT *, count(*) OVER (PARTITION BY storefront, cluster_id) AS n_members,
    row_number() OVER (PARTITION BY storefront, cluster_id ORDER BY {S.can_lead('term')} DESC, width DESC, term) AS rn
  FROM lst_members JOIN (SELECT storefront, term, count(DISTINCT track_id) FILTER (track_id <> 0) AS width FROM list_rows GROUP BY 1, 2)
    USING (storefront, term)) WHERE rn = 1"""
SQL["cluster_items"] = """
SELECT storefront, cluster_id, count(DISTINCT track_id) AS n_items FROM doc_members JOIN doc_rows USING (storefront, term)
WHERE track_id <> 0 GROUP BY 1, 2"""
_b.CTES["squashed"] = f"SELECT storefront, term, {S.squash('term')} AS sq FROM (SELECT DISTINCT storefront, term FROM sugg_short)"
_b.CTES["close_forms"] = f"""
  SELECT storefront, x, y, lcs * 200.0::DOUBLE / (length(x) + length(y)) AS ratio FROM (
    SELECT storefront, x, y, {S.lcs('x', 'y')} AS lcs FROM (
      SELECT p.storefront, p.sq AS x, q.sq AS y FROM (SELECT DISTINCT storefront, sq FROM squashed) p
      JOIN (SELECT DISTINCT storefront, sq FROM squashed) q ON p.storefront = q.storefront AND p.sq < q.sq
        AND abs(length(p.sq) - length(q.sq)) * 100 <= 12 * (length(p.sq) + length(q.sq))
        AND levenshtein(p.sq, q.sq) * 100 <= 12 * (length(p.sq) + length(q.sq))))
  WHERE lcs * 200 >= 88 * (length(x) + length(y))"""
SQL["fuzzy_pairs"] = f"""
SELECT c.storefront, least(l.term, r.term) AS a, greatest(l.term, r.term) AS b, {_r6('ratio')} FROM close_forms c
JOIN squashed l ON l.storefront = c.storefront AND l.sq = x JOIN squashed r ON r.storefront = c.storefront AND r.sq = y"""
_b.CTES["earlier"] = """
  SELECT t.storefront, t.term AS t, s.term AS s FROM squashed t JOIN squashed s ON t.storefront = s.storefront
    AND (length(s.term), s.term) < (length(t.term), t.term) AND s.sq = t.sq
  UNION SELECT c.storefront, CASE WHEN (length(l.term), l.term) < (length(r.term), r.term) THEN r.term ELSE l.term END,
    CASE WHEN (length(l.term), l.term) < (length(r.term), r.term) THEN l.term ELSE r.term END
  FROM close_forms c JOIN squashed l ON l.storefront = c.storefront AND l.sq = x
  JOIN squashed r ON r.storefront = c.storefront AND r.sq = y"""
_b.CTES["walks"] = """
  SELECT storefront, t, s FROM earlier
  UNION SELECT w.storefront, w.t, e.s FROM walks w JOIN earlier e ON w.storefront = e.storefront AND w.s = e.t"""
_b.RECURSIVE.add("walks")
_b.CTES["heads"] = """
  SELECT q.storefront, q.term, coalesce(h, q.term) AS head FROM squashed q
  LEFT JOIN (SELECT storefront, t, arg_min(s, (length(s), s)) AS h FROM walks GROUP BY 1, 2) w ON q.storefront = w.storefront AND q.term = w.t"""
SQL["variant_heads"] = "SELECT storefront, term, head FROM heads"
_b.CTES["probed"] = f"SELECT storefront, term, min(position)::INT AS position FROM {_MATCHED.replace('sugg_rows', 'sugg_short')} GROUP BY 1, 2"
_CH = {"squashed": "c_squashed", "close_forms": "c_close", "earlier": "c_earlier", "walks": "c_walks", "heads": "c_heads"}
for _name, _new in _CH.items():
    _text = _b.CTES[_name].replace("FROM sugg_short", "FROM probed")
    for _old, _other in _CH.items():
        _text = re.sub(rf"\b(FROM|JOIN) {_old}\b", rf"\1 {_other}", _text)
    _b.CTES[_new] = _text
_b.RECURSIVE.add("c_walks")
SQL["collection_heads"] = f"""
SELECT term, storefront, position, CASE WHEN len(list_filter({S.toks('term')}, lambda hb: hb IN {S.HINTS})) > 0 THEN 'BRAND' END AS kw_type
FROM (SELECT DISTINCT storefront, head AS term FROM c_heads) JOIN probed USING (storefront, term)
QUALIFY row_number() OVER (PARTITION BY storefront ORDER BY coalesce(position, 99), term) <= 60"""

_b.CTES["budget"] = SQL["collection_heads"]
_b.CTES["p_lang"] = """
  SELECT b.term, b.storefront, b.position AS suggest_pos, k.first_part, k.source, k.status, k.first_seen,
    CASE b.storefront WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' ELSE 'en' END AS lang, k.term AS kw, k.storefront AS ks
  FROM budget b JOIN kw_lang k ON k.first_part = (length(b.term) * 13 + coalesce(b.position, 0)) % 200 WHERE b.kw_type IS NULL"""
_b.CTES["p_rows"] = """
  SELECT p.term, p.storefront, l.* EXCLUDE (term, storefront) FROM p_lang p JOIN list_rows l ON l.term = kw AND l.storefront = ks"""
_PASS = {"list_rows": "p_rows", "kw_lang": "p_lang", "features": "p_features", "sims": "p_sims", "factors": "p_factors", "scored": "p_scored"}
for _name in ("features", "sims", "factors", "scored"):
    _text = _b.CTES[_name]
    for _old, _other in _PASS.items():
        _text = re.sub(rf"\b(FROM|JOIN) {_old}\b", rf"\1 {_other}", _text)
    _b.CTES[_PASS[_name]] = _text
SQL["collection_scores"] = "SELECT term, storefront, suggest_pos, score, verdict FROM p_scored"
_short = lambda sql: sql.replace("sugg_rows", "sugg_short")
SQL["collection_counters"] = f"""
SELECT storefront, 'suggestions' AS counter, count(*) AS n FROM probed GROUP BY 1
UNION ALL SELECT storefront, 'after_dedup', count(DISTINCT head) FROM c_heads GROUP BY 1
UNION ALL SELECT storefront, 'new_verbs', count(*) FROM (
  SELECT storefront, {S.sing("split_part(term, ' ', 1)")} AS verb FROM probed WHERE len({S.toks('term')}) >= 2
    AND length({S.sing("split_part(term, ' ', 1)")}) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2)
  WHERE verb NOT IN {S.STOP} AND verb NOT IN {SEEDS} GROUP BY 1
UNION ALL SELECT storefront, 'new_probes', count(*) FROM (
  SELECT storefront, token FROM ({_short(SQL['harvest_objects'])}) GROUP BY 1, 2 HAVING sum(n) >= 2) o
  WHERE token NOT IN {S.BROAD} AND token NOT IN {S.STOP} AND (storefront, token) NOT IN (
    SELECT (storefront, prefix) FROM sugg_rows WHERE length(prefix) % 2 = 0) GROUP BY 1
UNION ALL SELECT storefront, 'brand', count(*) FROM budget WHERE kw_type = 'BRAND' GROUP BY 1
UNION ALL SELECT storefront, 'empty_serp', count(*) FROM budget WHERE kw_type IS NULL
  AND (term, storefront) NOT IN (SELECT (term, storefront) FROM p_scored) GROUP BY 1
UNION ALL SELECT storefront, verdict, count(*) FROM p_scored GROUP BY 1, 2
UNION ALL SELECT storefront, 'gate_' || g, count(*) FROM (
  SELECT storefront, unnest(string_split(gates_failed, ',')) AS g FROM p_scored WHERE gates_failed <> '') GROUP BY 1, 2"""

# --- niches ----------------------------------------------------------------------------------
_b.CTES["queue"] = "SELECT * FROM scored WHERE status = 'queued'"
_b.CTES["q_rows"] = "SELECT * FROM list_rows WHERE (term, storefront) IN (SELECT (term, storefront) FROM queue)"
_cluster_ctes("q", "q_rows")
_b.CTES["niche_heads"] = f"""
  SELECT storefront, cluster_id, term, score, cluster_size FROM (
    SELECT m.storefront, cluster_id, m.term, score, count(*) OVER (PARTITION BY m.storefront, cluster_id) AS cluster_size,
      row_number() OVER (PARTITION BY m.storefront, cluster_id ORDER BY {S.can_lead('m.term')} DESC, score DESC, m.term) AS rn
    FROM q_members m JOIN queue q ON m.storefront = q.storefront AND m.term = q.term) WHERE rn = 1"""
_b.CTES["merged"] = """
  SELECT term, arg_min(storefront, (-score, storefront)) AS storefront, max(score) AS score,
    max(cluster_size) AS cluster_size, arg_min(storefront, (-cluster_size, -score, storefront)) AS variants_from,
    arg_min(cluster_id, (-cluster_size, -score, storefront)) AS variants_cluster,
    string_agg(DISTINCT upper(storefront), ',' ORDER BY upper(storefront)) AS markets
  FROM niche_heads GROUP BY 1"""
_b.CTES["niches"] = """
  SELECT q.* EXCLUDE (score), m.score, cluster_size, variants_from, variants_cluster, markets
  FROM merged m JOIN queue q ON m.term = q.term AND m.storefront = q.storefront"""
_b.CTES["niche_variants"] = """
  SELECT n.term AS head, n.storefront, m.term AS variant, q.score FROM merged n
  JOIN q_members m ON m.storefront = variants_from AND m.cluster_id = variants_cluster AND m.term <> n.term
  JOIN queue q ON q.storefront = m.storefront AND q.term = m.term"""
_b.CTES["judged"] = """
  SELECT n.*, v.category, v.niche_name, coalesce(top1_name_match >= 0.75, false) OR coalesce(v.category = 'brand', false) AS is_brand,
    coalesce(v.category IN ('too_broad', 'junk'), false) AS is_junk
  FROM niches n LEFT JOIN (SELECT * FROM verdicts WHERE accepted) v ON n.term = v.term AND n.storefront = v.storefront"""
_b.CTES["shown"] = f"""
  SELECT *, CASE WHEN is_brand THEN 'brand' WHEN is_junk THEN 'junk' ELSE 'niche' END AS route, first_seen > TIMESTAMP '2001-07-01' AS is_new
  FROM ({_rated("SELECT * FROM judged")}) WHERE term NOT IN (SELECT term FROM ({_HIDDEN}))"""
_count = lambda c: f"CASE WHEN {c} >= 1000 THEN ({c} // 1000) || 'k' ELSE {c}::VARCHAR END"
SQL["queue_top"] = """
SELECT term, storefront, score, suggest_pos FROM queue ORDER BY score DESC, term, storefront LIMIT 50"""
SQL["queue_json"] = """
SELECT term, storefront, score, string_split(notes, '; ')[1] AS first_note, weakness, market FROM queue ORDER BY score DESC, term, storefront LIMIT 50"""
SQL["merged_niches"] = "SELECT term, storefront, score, cluster_size, markets, variants_from FROM merged"
SQL["niche_variants"] = "SELECT head, storefront, variant, score FROM niche_variants"
SQL["niche_table"] = f"""
SELECT term, storefront, route, coalesce(nullif(niche_name, ''), term) AS display_name, stars, score,
  CASE WHEN score >= 60 THEN '{L.BAND_STRONG}' WHEN score >= 35 THEN '{L.BAND_MEDIUM}' ELSE '{L.BAND_WEAK}' END AS band,
  cluster_size, replace(markets, ',', ', ') AS markets, is_new, NOT {S.can_lead('term')} AS is_broad, suggest_pos,
  floor(in_metadata_share * 10 + 0.5)::INT || '/10' AS in_metadata, floor(stale_share * 10 + 0.5)::INT || '/10' AS stale,
  {_count('top1_reviews')} AS leader_reviews, leader_rating, flags FROM shown"""
SQL["niche_order"] = """
SELECT term, storefront, stars, score, is_new FROM shown WHERE route = 'niche'
ORDER BY is_new DESC, stars DESC, score DESC, term, storefront LIMIT 40"""
SQL["brand_leads"] = """
SELECT term, storefront, score, leader_title FROM shown WHERE route = 'brand' ORDER BY score DESC, term, storefront LIMIT 8"""
SQL["weekly_niches"] = """
SELECT term, storefront, stars, score, route FROM shown WHERE route <> 'brand'
ORDER BY stars DESC, score DESC, term, storefront LIMIT 30"""
SQL["route_counts"] = "SELECT route, count(*) AS n, count(*) FILTER (is_new) AS n_new FROM shown GROUP BY 1"
_b.CTES["ideas_list"] = f"""
  SELECT CASE WHEN sign <> '' OR is_brand THEN 'brand' ELSE 'idea' END AS section, term, storefront, popularity, source, stars, score,
    cluster_size, CASE WHEN sign <> '' THEN sign WHEN is_brand THEN '{L.BRAND_BY_TITLE}' END AS brand_why, leader_title
  FROM (SELECT r.*, p.popularity, CASE WHEN top1_name_match >= 0.75 THEN '{L.BRAND_BY_TITLE}'
      WHEN {S.name_match('r.term', 'top1_seller')} >= 0.75 THEN '{L.BRAND_BY_SELLER}'
      WHEN len({S.toks(_plain('r.term'))}) = 1 AND split_part({_plain('leader_title')}, ' ', 1) = {_plain('r.term')} THEN '{L.BRAND_BY_FIRST_WORD}'
      ELSE '' END AS sign
    FROM ({_rated("SELECT * FROM judged")}) r LEFT JOIN (
      SELECT term, storefront, popularity FROM keyword_pop) p
      ON r.term = p.term AND r.storefront = p.storefront
    WHERE NOT is_junk AND r.term NOT IN (SELECT term FROM ({_HIDDEN})))"""
_b.CTES["keyword_pop"] = """
  SELECT term, storefront, greatest(1, 101 - row_number() OVER (PARTITION BY storefront ORDER BY volume DESC, term))::INT AS popularity
  FROM (SELECT term, storefront, sum(l_quantity) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN kw_text ON l_partkey = p_partkey
        WHERE date_trunc('month', o_orderdate) = (
          SELECT max(date_trunc('month', o_orderdate)) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
          WHERE date_trunc('month', o_orderdate) < (SELECT date_trunc('month', max(o_orderdate)) FROM orders))
        GROUP BY 1, 2)"""
_b.CTES["sightings"] = """
  SELECT term, storefront, ts AS seen_at, event_id % 12 + 1 AS position FROM events JOIN kw_text ON user_id = p_partkey"""
_b.CTES["evidence"] = f"""
  SELECT s.*, coalesce(nullif(d.arrow, '{L.NONE}'), nullif(t.arrow, '{L.NONE}'), '{L.NONE}') AS trend
  FROM shown s LEFT JOIN ({_DEMAND.replace('sugg_rows', 'sightings')}) d ON s.term = d.term AND s.storefront = d.storefront
  LEFT JOIN ({_TRAFFIC}) t ON s.leader_id = t.track_id AND s.storefront = t.storefront"""
SQL["niche_evidence"] = "SELECT term, storefront, trend, string_split(notes, '; ')[1] AS why, missing FROM evidence"
SQL["headline_reasons"] = "SELECT term, storefront, string_split(notes, '; ')[1] AS why FROM scored"
SQL["weekly_report"] = f"""
SELECT 'niche' AS section, place::INT AS place, repeat('★', stars::INT) || ' | ' || coalesce(nullif(niche_name, ''), term) || ' | '
  || upper(storefront) || ' | ' || trend AS line
FROM (SELECT *, row_number() OVER (ORDER BY stars DESC, score DESC, term, storefront) AS place FROM evidence WHERE route <> 'brand') WHERE place <= 30
UNION ALL
SELECT 'alert', place::INT, title || ' (' || upper(storefront) || '){L.ALERT_RATING}' || {S.half_up('rating_first', 1)} || ' → '
  || {S.half_up('rating_last', 1)} || '{L.ALERT_CHANCE}'
FROM (SELECT *, row_number() OVER (ORDER BY {S.half_up('rating_first - rating_last', 6)} DESC, track_id, storefront) AS place
      FROM ({SQL['decay_alerts']})) WHERE place <= 5"""
SQL["review_growth"] = f"""
SELECT k.term, k.storefront, weekly_review_delta AS top1_weekly_review_delta, est_monthly_installs
FROM kw_lang k JOIN (SELECT * FROM list_rows WHERE pos = 1) l ON k.term = l.term AND k.storefront = l.storefront
LEFT JOIN ({SQL['review_delta']}) d ON d.track_id = l.track_id AND d.storefront = l.storefront"""
SQL["newest_snapshots"] = """
WITH listed AS (
  SELECT term, storefront, taken_at, string_agg(l_suppkey::VARCHAR, ',' ORDER BY pos) AS items,
    row_number() OVER (PARTITION BY term, storefront ORDER BY taken_at DESC) AS age FROM (
    SELECT term, storefront, date_trunc('year', l_shipdate)::DATE AS taken_at, l_suppkey, row_number() OVER (
      PARTITION BY term, storefront, date_trunc('year', l_shipdate)::DATE ORDER BY sum(l_quantity) DESC, l_suppkey) AS pos
    FROM lineitem JOIN kw_text ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4) WHERE pos <= 10 GROUP BY 1, 2, 3)
SELECT n.term, n.storefront, n.taken_at, n.items, o.taken_at AS before, o.items AS items_before
FROM listed n LEFT JOIN listed o ON o.term = n.term AND o.storefront = n.storefront AND o.age = 2 WHERE n.age = 1"""
SQL["decision_context"] = """
SELECT d.term, d.storefront, d.event_id::VARCHAR AS reason, d.verdict, (
  SELECT arg_max(s.position, (s.seen_at, s.position)) FROM sightings s WHERE s.position <= 6 AND s.term = d.term
    AND s.storefront = d.storefront AND s.seen_at <= d.decided_at)::INT AS position
FROM decisions d WHERE verdict IN ('go', 'no_go')"""
_b.CTES["history"] = """
  SELECT term, storefront, taken_at, l_suppkey AS track_id, qty FROM (
    SELECT *, row_number() OVER (PARTITION BY term, storefront, taken_at ORDER BY qty DESC, l_suppkey) AS pos FROM (
      SELECT term, storefront, date_trunc('year', l_shipdate)::DATE AS taken_at, l_suppkey, sum(l_quantity) AS qty
      FROM lineitem JOIN kw_text ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)) WHERE pos <= 10 AND l_suppkey <> 0"""
SQL["item_store"] = """
SELECT track_id, storefront, 'item of ' || arg_max(term, (taken_at, term)) AS title, 'genre ' || min(taken_at) AS primary_genre,
  max(taken_at) AS updated_at FROM history GROUP BY 1, 2"""
SQL["metric_store"] = """
SELECT track_id, storefront, taken_at AS day, 3.0::DOUBLE + arg_max(qty, term) % 20 / 10.0::DOUBLE AS rating,
  arg_max(qty, term)::BIGINT AS rating_count FROM history GROUP BY 1, 2, 3"""
SQL["score_store"] = f"""
SELECT term, storefront, status_after AS status, CASE WHEN status NOT IN ('in_astro', 'go', 'no_go', 'narrow', 'hold') THEN score END AS score,
  {_r6('coherence')} FROM scored"""
SQL["verdict_store"] = """
SELECT term, storefront, CASE WHEN length(term) % 2 = 0 THEN 'niche' ELSE category END AS category, confidence, note FROM verdicts WHERE accepted"""
_STORES = ", ".join(f"({i}, '{key}', '{lang}')" for i, (key, lang) in enumerate(STOREFRONTS))
SQL["storefront_choice"] = f"""
WITH asked AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0
    THEN regexp_replace(stores, 'GB|us', 'xx', 'g') ELSE stores END END AS stores
  FROM (SELECT c_custkey, ' GB,' || right(c_name, 2) || ',' || ['us', 'de', 'FR ', 'zz', ''][c_custkey % 5 + 1] AS stores FROM customer)),
names AS (SELECT DISTINCT request_id, trim(unnest(string_split(lower(coalesce(stores, '')), ','))) AS name FROM asked),
store AS (SELECT * FROM (VALUES {_STORES}) v(i, storefront, lang)),
hit AS (SELECT request_id, i, storefront, lang FROM names JOIN store ON name = storefront),
chosen AS (SELECT * FROM hit UNION ALL SELECT request_id, i, storefront, lang FROM asked, store WHERE i = 0
           AND request_id NOT IN (SELECT request_id FROM hit))
SELECT c.request_id, (row_number() OVER (PARTITION BY c.request_id ORDER BY i) - 1)::INT AS place, c.storefront, c.lang,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM names n WHERE n.request_id = c.request_id AND name <> ''
            AND name NOT IN (SELECT storefront FROM store)), '') AS unknown
FROM chosen c"""
SQL["idea_list"] = "SELECT * FROM ideas_list"
SQL["measured_ideas"] = """
SELECT term, storefront, popularity, stars FROM ideas_list WHERE section = 'idea' AND popularity IS NOT NULL AND source = 'suggest'
ORDER BY popularity DESC, stars DESC, term, storefront LIMIT 40"""
SQL["generation_seeds"] = f"""
SELECT term, storefront, stars, score FROM ({_rated("SELECT * FROM judged")}) WHERE NOT is_brand AND NOT is_junk
ORDER BY stars DESC, score DESC, term, storefront LIMIT 5"""
SQL["unjudged_niches"] = """
SELECT term, storefront, score FROM niches WHERE (term, storefront) NOT IN (SELECT (term, storefront) FROM verdicts WHERE accepted)
ORDER BY score DESC, term, storefront LIMIT 30"""
SQL["queue_csv"] = f"""
SELECT stars AS звёзды, upper(r.storefront) AS магазин, r.term AS ниша, cluster_size AS запросов, score, leader_title AS лидер,
  leader_rating AS рейтинг, top1_reviews AS отзывы, floor(stale_share * 10)::INT || '/10' AS устарело, flags AS флаги,
  coalesce(listed, '') AS варианты FROM ({_rated("SELECT * FROM niches")}) r
LEFT JOIN (SELECT head, storefront, string_agg(variant, ', ' ORDER BY score DESC, variant) AS listed
  FROM niche_variants GROUP BY 1, 2) v ON r.term = head AND r.storefront = v.storefront"""
SQL["dossiers"] = f"""
WITH h AS (SELECT term, storefront FROM queue ORDER BY score DESC, term, storefront LIMIT 50),
lines AS (SELECT term, storefront, string_agg(pos || ' | ' || substr(title, 1, 48) || ' | ' || coalesce(rating, 0.0) || ' | ' || rating_count || ' | '
    || coalesce((days_since_update // 30)::VARCHAR, 'n/a'), chr(10) ORDER BY pos) AS result_lines FROM list_rows JOIN h USING (term, storefront) GROUP BY 1, 2),
rel AS (SELECT token, string_agg(suggestion, ', ' ORDER BY place) AS suggestions FROM (
  SELECT token, suggestion, row_number() OVER (PARTITION BY token ORDER BY position, suggestion) AS place
  FROM (SELECT DISTINCT split_part(term, ' ', 1) AS token FROM h)
  JOIN (SELECT term AS suggestion, min(position) AS position FROM sugg_rows GROUP BY 1) ON contains(suggestion, token)) WHERE place <= 25 GROUP BY 1),
meta AS (SELECT term, storefront, string_agg(token, ', ' ORDER BY n DESC, token) AS metadata_tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY term, storefront ORDER BY n DESC, token) AS rn FROM ({SQL['metadata_tokens']})) WHERE rn <= 20 GROUP BY 1, 2)
SELECT h.term, h.storefront, result_lines, coalesce(CASE WHEN h.storefront IN ('us', 'gb', 'de', 'fr') THEN suggestions END, '') AS suggestions,
  coalesce(metadata_tokens, '') AS metadata_tokens
FROM h JOIN lines USING (term, storefront) LEFT JOIN rel ON split_part(h.term, ' ', 1) = token
LEFT JOIN meta ON meta.term = h.term AND meta.storefront = h.storefront"""
SQL["fact_sheet"] = """
SELECT m.storefront, cluster_id, m.term, CASE WHEN m.term = cluster_id THEN 'HEAD' ELSE 'BODY' END AS kw_type,
  f.popularity, f.difficulty, title AS top1
FROM lst_members m JOIN (SELECT term, storefront, max(p_size)::DOUBLE AS popularity, max(p_partkey % 100)::DOUBLE AS difficulty
  FROM kw_text GROUP BY 1, 2) f ON m.term = f.term AND m.storefront = f.storefront
LEFT JOIN (SELECT term, storefront, title FROM list_rows WHERE pos = 1) l ON l.term = m.term AND l.storefront = m.storefront"""
SQL["classifier_input"] = f"""
SELECT term, storefront, n_paid::INT AS n_paid, 'Query: "' || term || '"' || chr(10) || 'Storefront: ' || upper(storefront) || chr(10) || lines || chr(10)
  || 'Of the top ' || n || ', ' || n_paid || ' charge upfront.' || chr(10) || 'Name similarity between the query and result #1: '
  || floor(top1_name_match * 100 + 0.5)::INT || '/100.' || chr(10) || 'Other queries with the same results: '
  || CASE WHEN top1_seller <> 'Google LLC' THEN '"' || top1_seller || '", ' ELSE '' END || '"' || split_part(term, ' ', 1) || '"' AS model_input
FROM (SELECT term, storefront, count(*) AS n, sum((price > 0)::INT) AS n_paid, string_agg('  ' || pos || '. "' || substr(title, 1, 70) || '" by '
    || substr(seller, 1, 40) || ' — ' || printf('%.1f', coalesce(rating, 0.0)) || ' stars, ' || rating_count || ' ratings, '
    || CASE WHEN price > 0 THEN 'paid $' || printf('%.2f', price) || ' upfront' ELSE 'free to download' END, chr(10) ORDER BY pos) AS lines
  FROM list_rows WHERE pos <= 6 GROUP BY 1, 2) JOIN features USING (term, storefront) JOIN sims USING (term, storefront)"""

# --- streams ---------------------------------------------------------------------------------
SQL["stream_daily_metrics"] = """
SELECT user_id AS track_id, 'us' AS storefront, ts::DATE AS day, value AS rating FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1"""
SQL["stream_suggestions"] = SQL["decode_suggestions"]
SQL["stream_popularity"] = f"SELECT term, country, genre, period, pop_1to100 FROM ({SQL['popularity_upsert']})"
