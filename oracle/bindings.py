"""The bindings of demandscope.plans.bindings as SQL common table expressions."""

import re

from oracle.fragments import content, norm, sing, toks  # noqa: F401

CTES: dict[str, str] = {}
RECURSIVE: set[str] = set()


def _sold(unit: str) -> str:
    return f"""
  SELECT l_partkey, lower(r_name) AS country, date_trunc('{unit}', o_orderdate)::DATE AS period,
         sum(l_quantity) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE date_trunc('{unit}', o_orderdate) < (SELECT date_trunc('{unit}', max(o_orderdate)) FROM orders)
  GROUP BY 1, 2, 3"""


def _ranked(volumes: str, granularity: str) -> str:
    return f"""
  SELECT term, country, genre, period, '{granularity}' AS granularity, rank_in_genre::INT AS rank_in_genre,
         greatest(1, 101 - rank_in_genre)::INT AS pop_1to100
  FROM (SELECT *, row_number() OVER (PARTITION BY country, genre, period ORDER BY volume DESC, term) AS rank_in_genre
        FROM ({volumes}))"""


CTES["sold_month"] = _sold("month")
CTES["sold_quarter"] = _sold("quarter")
CTES["pop"] = _ranked("""SELECT p_name AS term, country, 'all' AS genre, period, sum(volume) AS volume
    FROM sold_month JOIN part ON l_partkey = p_partkey GROUP BY ALL""", "MONTHLY")
CTES["popq"] = _ranked("""SELECT p_name AS term, country, lower(p_type) AS genre, period, sum(volume) AS volume
    FROM sold_quarter JOIN part ON l_partkey = p_partkey GROUP BY ALL""", "QUARTERLY")
CTES["popf"] = _ranked("""SELECT 'part ' || p_partkey AS term, country, lower(p_type) AS genre, period, volume
    FROM sold_month JOIN part ON l_partkey = p_partkey""", "MONTHLY")

CTES["kw_text"] = """
  SELECT p_partkey, split_part(p_name, ' ', 2) || ' ' || (p_partkey // 10) AS term,
         CASE p_type WHEN 'ECONOMY' THEN 'us' WHEN 'SMALL' THEN 'gb' WHEN 'MEDIUM' THEN 'de' WHEN 'PROMO' THEN 'fr'
                     WHEN 'STANDARD' THEN 'jp' ELSE 'zz' END AS storefront, p_size, p_name FROM part"""
CTES["supply"] = """
  SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty, min(l_shipdate)::DATE AS first_ship,
         max(l_shipdate)::DATE AS last_ship FROM lineitem GROUP BY 1, 2"""
CTES["main_name"] = """
  SELECT l_suppkey, p_name AS main FROM (
    SELECT l_suppkey, p_name, sum(qty) AS qty FROM supply JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, p_name) = 1"""
CTES["items"] = """
  SELECT s_suppkey AS track_id,
    CASE s_suppkey % 4 WHEN 0 THEN main || ': ' || s_name WHEN 1 THEN main || ' app' WHEN 2 THEN s_name || ' - ' || main
         ELSE split_part(main, ' ', 2) || 's & ' || main END AS title,
    'simple ' || split_part(main, ' ', 2) || 's with ' || ['widgets', 'rings', 'gears'][s_suppkey % 3 + 1] AS subtitle,
    CASE WHEN s_suppkey % 23 = 0 THEN 'Google LLC' ELSE s_name END AS seller,
    CASE WHEN s_suppkey % 9 = 0 THEN 'Games' ELSE 'Utilities' END AS primary_genre,
    CASE WHEN s_suppkey % 7 = 0 THEN 'Games' ELSE 'Work' END AS genre2,
    CASE WHEN s_suppkey % 11 <> 5 THEN 3.0::DOUBLE + (s_suppkey * 37 % 20)::DOUBLE / 10.0::DOUBLE END AS rating,
    (s_suppkey * s_suppkey * 7919 + s_suppkey * 104729) % 150000 * CASE WHEN s_suppkey % 13 = 0 THEN 10 ELSE 1 END AS rating_count,
    CASE WHEN s_suppkey % 5 = 0 THEN 1.99::DOUBLE ELSE 0.0::DOUBLE END AS price,
    CASE WHEN s_suppkey % 3 = 0 THEN 'EN' ELSE 'ES' END AS lang1,
    ['DE', 'FR', 'JA', 'ET', 'SV'][s_nationkey % 5 + 1] AS lang2
  FROM supplier JOIN main_name ON s_suppkey = l_suppkey"""
CTES["list_rows"] = """
  SELECT term, storefront, pos, i.*,
    CASE WHEN track_id % 17 <> 3 THEN date_diff('day', last_ship, DATE '2002-01-01') END AS days_since_update,
    date_diff('day', first_ship, DATE '2002-01-01') AS age_days
  FROM (SELECT term, storefront, l_suppkey, min(first_ship) AS first_ship, max(last_ship) AS last_ship,
          row_number() OVER (PARTITION BY term, storefront ORDER BY sum(qty) DESC, l_suppkey) AS pos
        FROM supply JOIN kw_text ON l_partkey = p_partkey GROUP BY term, storefront, l_suppkey) r
  JOIN items i ON r.l_suppkey = i.track_id WHERE pos <= 10"""
CTES["keywords"] = """
  SELECT term, storefront, CASE WHEN min(p_partkey) % 3 = 0 THEN 'asa' ELSE 'suggest' END AS source,
    min(CASE WHEN p_size % 6 <> 5 THEN p_size % 12 + 1 END) AS suggest_pos,
    ['new', 'queued', 'watchlist', 'rejected', 'in_astro', 'go', 'queued'][min(p_partkey) % 7 + 1] AS status,
    TIMESTAMP '2001-01-01' + to_days((min(p_partkey) % 300)::INT) AS first_seen, min(p_partkey) AS first_part
  FROM kw_text GROUP BY 1, 2"""
CTES["kw_lang"] = """
  SELECT k.*, CASE storefront WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'jp' THEN 'ja' ELSE 'en' END AS lang
  FROM keywords k WHERE (term, storefront) IN (SELECT (term, storefront) FROM list_rows)"""

CTES["doc_rows"] = """
  SELECT 'doc ' || doc_id AS term, storefront, pos, ('0x' || substr(md5(token), 1, 15))::BIGINT AS track_id
  FROM (SELECT doc_id, storefront, token, row_number() OVER (PARTITION BY storefront, doc_id ORDER BY df, token) AS pos
        FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM (
          SELECT doc_id, lang AS storefront, unnest(list_distinct(""" + toks("lower(text)") + """)) AS token FROM documents)))
  WHERE pos <= 10"""
CTES["crowd_rows"] = CTES["doc_rows"].replace("ORDER BY df, token", "ORDER BY df DESC, token")
CTES["sugg_rows"] = f"""
  SELECT doc_id, line, storefront, ws[1] AS prefix, array_to_string(ws, ' ') AS term,
         line % 10 + 1 AS position, TIMESTAMP '2024-01-01' + to_days((doc_id % 90)::INT) AS seen_at
  FROM (SELECT doc_id, lang AS storefront, line - 1 AS line, {toks(norm('raw'))} AS ws
        FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))
  WHERE len(ws) >= 2"""
CTES["sugg_short"] = CTES["sugg_rows"].replace("array_to_string(ws, ' ') AS term", "array_to_string(ws[1:3], ' ') AS term")
CTES["metrics"] = """
  SELECT track_id, 'us' AS storefront, day,
         floor(cents::DOUBLE / (n * 100) * 10) / 100.0::DOUBLE + 2.0::DOUBLE AS rating,
         (sum(n) OVER (PARTITION BY track_id ORDER BY day))::BIGINT AS rating_count
  FROM (SELECT user_id AS track_id, ts::DATE AS day, count(*) AS n,
               sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2)"""
CTES["decisions"] = """
  SELECT term, storefront, ts AS decided_at, event_id,
    CASE event_type WHEN 'view' THEN 'skip' WHEN 'click' THEN 'later' WHEN 'signup' THEN 'astro'
                    WHEN 'purchase' THEN 'go' WHEN 'error' THEN 'no_go' END AS verdict
  FROM events JOIN kw_text ON user_id = p_partkey"""
CTES["titles"] = f"""
  SELECT page_id, title, seller, array_to_string({toks(norm('title'))}[1:(page_id % 3 + 1)], ' ') AS term
  FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               regexp_extract(url, '^https?://([^/]+)', 1) AS seller FROM pages)"""
CTES["verdicts"] = """
  SELECT term, storefront, first_part, accepted,
    CASE WHEN accepted THEN category END AS category,
    CASE WHEN accepted THEN CASE WHEN first_part % 4 = 0 THEN 'navigational' ELSE 'transactional' END END AS intent,
    CASE WHEN accepted THEN CASE WHEN first_part % 7 = 0 THEN 0.5::DOUBLE
                                 ELSE least((first_part % 15)::DOUBLE / 10.0::DOUBLE, 1.0::DOUBLE) END END AS confidence,
    CASE WHEN accepted THEN substr(CASE WHEN first_part % 5 = 0 THEN term ELSE 'need ' || term END, 1, 60) END AS niche_name,
    CASE WHEN accepted THEN 'n' || first_part END AS note
  FROM (SELECT term, storefront, first_part,
          ['niche', 'brand', 'niche', 'too_broad', 'junk', 'nonsense'][first_part % 6 + 1] AS category,
          first_part % 9 NOT IN (2, 3) AND first_part % 6 <> 5 AS accepted FROM keywords)"""
_openings = f"list_transform(string_split_regex(text, '[.\\n]'), lambda so, si: array_to_string({toks(norm('so'))}[1:((si - 1) % 3 + 1)], ' '))"
CTES["ideas"] = f"""
  SELECT source_term, 'us' AS storefront, row_number() OVER (PARTITION BY source_term ORDER BY ix) AS place, query,
         'sentence ' || (ix - 1) AS why
  FROM (SELECT source_term, query, min(ix) AS ix FROM (
          SELECT 'conv ' || conv_id || ' ' || turn AS source_term, unnest({_openings}) AS query,
                 generate_subscripts({_openings}, 1) AS ix FROM conversations)
        WHERE len({toks('query')}) >= 2 AND length(query) <= 60 GROUP BY 1, 2)
  QUALIFY place <= 8"""
CTES["proposals"] = """
  SELECT term AS query, storefront, min(doc_id) AS first_doc FROM sugg_rows GROUP BY 1, 2"""


def with_ctes(body: str) -> str:
    """Prefix a statement with the CTEs it uses, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text):
                seen.add(name)
                visit(CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n]})" for n in order)
    stripped = re.sub(r"^\s*WITH( RECURSIVE)?\s", ", ", body)
    return f"WITH RECURSIVE {ctes}\n{stripped}"
