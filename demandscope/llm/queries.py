"""The corpus operators on their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandscope.llm.byte_ppm import byte_ppm
from demandscope.llm.common import read
from demandscope.llm.exact_dedup import exact_dedup
from demandscope.llm.license_scan import TEMPLATES, license_scan
from demandscope.llm.license_scan import THRESHOLD as LICENSE_THRESHOLD
from demandscope.llm.line_dedup import line_dedup
from demandscope.llm.mixing import BLOCK_CHARS, PERIOD, mix
from demandscope.llm.ngram_jaccard import near_classes
from demandscope.llm.packing import pack
from demandscope.llm.periodic_runs import periodic_runs, run_digests
from demandscope.llm.pii import pii_spans
from demandscope.llm.prefix_trie import FAMILY, LONGEST_HEAD, TIE, conversation_trie
from demandscope.llm.quality_classifier import quality_scores
from demandscope.llm.quality_rules import quality_rules
from demandscope.llm.wavelet import token_documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"), near=None)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(read(spark, sf_dir, "documents"))


def op11_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ppm(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """One document in ten gets a periodic end: its last words repeat a stretch of themselves."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(read(spark, sf_dir, "documents"), planted))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string")) % (LONGEST_HEAD + 1)
    return conversation_trie(read(spark, sf_dir, "conversations"), head)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_line_dedup, op3_exact_dedup, op4_quality_classifier, op5_quality_rules, op6_pii, op7_ngram_jaccard, op8_packing,
        op9_mixing, op10_wavelet_tokens, op11_byte_ppm, op12_periodic_runs, op13_prefix_trie)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_TEMPLATES = ", ".join(f"({i}, {_text(name)}, {_text(text)})" for i, (name, text) in enumerate(TEMPLATES))
_T = LICENSE_THRESHOLD

SQL = {
    "op1_license_scan": rf"""
        WITH template AS (
            SELECT i, license, {_PAIRS} AS tp FROM (
                SELECT i, license, string_split(trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')), ' ') AS w
                FROM (VALUES {_TEMPLATES}) AS v(i, license, t))),
        plain AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM documents),
        part AS (
            SELECT r, p, string_split(p, chr(10)) AS lines, string_split_regex(p, '\n(?: ?\n)+') AS paragraphs FROM plain),
        unit AS (
            SELECT r, 'line' AS unit, unnest(range(len(lines))) AS place, unnest(lines) AS u FROM part
            UNION ALL SELECT * FROM (
                SELECT r, 'paragraph', unnest(range(len(paragraphs))), unnest(paragraphs) AS u FROM part)
            WHERE contains(trim(u, ' '), chr(10))
            UNION ALL SELECT r, 'text', 0, p FROM part WHERE len(paragraphs) > 1),
        pairs AS (
            SELECT r, unit, place, {_PAIRS} AS up FROM (
                SELECT r, unit, place, string_split_regex(trim(translate(u, chr(10), ' ')), ' +') AS w FROM unit)),
        dice AS (
            SELECT r, unit, place, i, license, 2.0::DOUBLE * len(list_intersect(up, tp)) / (len(up) + len(tp)) AS d
            FROM pairs JOIN template
            ON len(up) BETWEEN {_T} * len(tp) / (2 - {_T}) - 1e-9 AND (2 - {_T}) * len(tp) / {_T} + 1e-9),
        best AS (
            SELECT r, unit, place, arg_min(license, i) AS license, any_value(d) AS d FROM (
                SELECT *, max(d) OVER (PARTITION BY r, unit, place) AS top FROM dice WHERE d >= {_T})
            WHERE d = top GROUP BY r, unit, place)
        SELECT doc_id, count(unit) AS n_hits,
               coalesce(array_to_string(list_sort(list_distinct(list(license) FILTER (unit IS NOT NULL))), ','), '') AS licenses,
               coalesce(max(d), 0) AS best,
               coalesce(string_agg(unit || ':' || place || ':' || license, ',' ORDER BY unit, place) FILTER (unit IS NOT NULL), '') AS hits
        FROM plain LEFT JOIN best USING (r) GROUP BY r, doc_id""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)""",
    "op9_mixing": f"""
        WITH RECURSIVE row AS (
            SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS chars FROM documents),
        stream AS (
            SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY doc_id, chars
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin" FROM row),
        size AS (SELECT source, pow(sum(chars) + 1, 0.5) AS size FROM row GROUP BY source),
        weight AS (
            SELECT source, greatest(1, round({PERIOD} * size / (SELECT sum(size) FROM size)))::BIGINT AS weight FROM size),
        own AS (
            SELECT list(source ORDER BY source) AS sources, list(weight ORDER BY source) AS a, sum(weight)::BIGINT AS period
            FROM weight),
        slot AS (
            SELECT -1::BIGINT AS slot, list_transform(a, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS place FROM own
            UNION ALL
            SELECT slot, list_transform(done, lambda n, s: n + (s = place)::BIGINT), place FROM (
                SELECT slot + 1 AS slot, done, list_min(list_filter(list_transform(a, lambda x, s:
                    CASE WHEN done[s] * period // x <= slot + 1
                         THEN ((done[s] + 1) * period + x - 1) // x * 1000000 + s END), lambda k: k IS NOT NULL)) % 1000000 AS place
                FROM slot, own WHERE slot + 1 < period)),
        plan AS (
            SELECT sources[place] AS source, any_value(a[place]) AS weight, any_value(period) AS period,
                   list(slot ORDER BY slot) AS slots
            FROM slot, own WHERE place IS NOT NULL GROUP BY place, sources)
        SELECT doc_id, source, chars, "begin", "begin" // {BLOCK_CHARS} AS block,
               "begin" // {BLOCK_CHARS} // weight * period + slots["begin" // {BLOCK_CHARS} % weight + 1] AS slot,
               "begin" // {BLOCK_CHARS} * period // weight AS release,
               (("begin" // {BLOCK_CHARS} + 1) * period + weight - 1) // weight AS deadline
        FROM stream JOIN plan USING (source)""",
    "op13_prefix_trie": f"""
        WITH crc AS (  -- the table of CRC-32, from its polynomial
            SELECT list(list_reduce(list_prepend(i, repeat([0], 8)), lambda a, b:
                CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
        own AS (
            SELECT conv_id, r, t, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, left(t, {TIE}), sha256(length(r) || ':' || r || t)) AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                  WHERE conv_id IS NOT NULL)),
        conv AS (
            SELECT conv_id AS c, conv_id - conv_id % {FAMILY} AS b, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) % {LONGEST_HEAD + 1} AS h
            FROM (SELECT DISTINCT conv_id FROM own), crc),
        turn AS (
            SELECT c, pos AS d, r, t FROM conv JOIN own ON conv_id = b AND pos <= h
            UNION ALL
            SELECT c, pos - h + (SELECT count(*) FROM own AS o WHERE o.conv_id = b AND o.pos <= h), r, t
            FROM conv JOIN own ON conv_id = c AND pos > h),
        path AS (
            SELECT c, d, length(t) AS chars, list(struct_pack(r := r, t := t)) OVER (PARTITION BY c ORDER BY d) AS key,
                   max(d) OVER (PARTITION BY c) AS total FROM turn
            UNION ALL SELECT c, 0, 0, [], coalesce((SELECT max(d) FROM turn AS x WHERE x.c = conv.c), 0) FROM conv),
        step AS (
            SELECT c, d, chars, total, min(c) OVER (PARTITION BY d, key) AS owner, count(*) OVER (PARTITION BY d, key) AS n
            FROM path),
        node AS (
            SELECT owner, d, any_value(n) AS n, any_value(chars) AS chars, count(*) FILTER (total > d) = 0 AS leaf,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends
            FROM step GROUP BY owner, d),
        up AS (SELECT node.*, p.owner AS parent FROM node LEFT JOIN step AS p ON p.c = node.owner AND p.d = node.d - 1),
        below AS (
            SELECT a.owner, a.d, count(*) FILTER (node.leaf) AS n_leaves, sum((node.n - 1) * node.chars) AS saved
            FROM node JOIN step AS a ON a.c = node.owner AND a.d <= node.d GROUP BY a.owner, a.d)
        SELECT up.owner AS conv_id, up.d::BIGINT AS depth, up.parent AS parent_conv_id, up.n AS n_convs,
               (SELECT count(*) FROM up AS k WHERE k.parent = up.owner AND k.d = up.d + 1) AS n_children,
               n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
        FROM up JOIN below ON below.owner = up.owner AND below.d = up.d""",
}
