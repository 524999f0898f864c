"""Registered queries of the text operators, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mastline.llm import fingerprints, licenses, lines, minhash, mixing, negatives, packing, pii, quality, simhash, substrings, suffixes, whitening
from mastline.llm.tables import documents
from mastline.llm.vectors import embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


SQL["op1_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') AS ts FROM d),
p AS (SELECT r, doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS k, len(ts) AS n FROM t),
w AS (SELECT r, doc_id, k, n, regexp_replace(token, '^[\\x20\\x09-\\x0D]+', '') AS raw, lower(raw) AS word,
  CAST(sum(length(token)) OVER o AS BIGINT) AS stop, sum(length(token) - length(replace(token, chr(10), ''))) OVER o AS line,
  substr(md5(lower(regexp_replace(token, '^[\\x20\\x09-\\x0D]+', ''))), 1, 1) IN ('0', '1', '2') AS cut
  FROM p WINDOW o AS (PARTITION BY r ORDER BY k)),
ws AS (SELECT r, list(word ORDER BY k) AS words FROM w GROUP BY r),
e AS (SELECT r, doc_id, k, k = 0 OR lag(cut) OVER (PARTITION BY r ORDER BY k) AS begins,
  min(CASE WHEN cut OR k = n - 1 THEN k END) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_end FROM w),
s AS (SELECT r, doc_id, k AS a, begins, lead(next_end, 14) OVER (PARTITION BY r ORDER BY k) AS b FROM e),
u AS (SELECT r, doc_id, a, b, 'W' || array_to_string(words[a + 1:b + 1], ' ') AS unit FROM s JOIN ws USING (r) WHERE begins AND b IS NOT NULL
  UNION ALL SELECT r, doc_id, min(k), max(k), 'L' || string_agg(word, ' ' ORDER BY k) FROM w GROUP BY r, doc_id, line HAVING count(*) >= 15),
g AS (SELECT r, a, b FROM (SELECT *, rank() OVER (PARTITION BY unit ORDER BY doc_id, a) AS place FROM u WHERE doc_id IS NOT NULL) WHERE place > 1),
gone AS (SELECT r, k, k - row_number() OVER (PARTITION BY r ORDER BY k) AS island FROM (SELECT DISTINCT r, unnest(range(a, b + 1)) AS k FROM g)),
spans AS (SELECT r, min(w.stop - length(w.raw)) AS a, max(w.stop) AS b FROM gone JOIN w USING (r, k) GROUP BY r, island),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS spans,
  string_agg(substr(text, before + 1, a - before), '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS kept_text FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans, coalesce(kept_text, text) AS kept_text,
  sha256(coalesce(kept_text, text)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


SQL["op2_minhash_near_dedup"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) >= 5 THEN ws[k:k + 4] ELSE ws END, ' ') AS g FROM k),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN z p ON x = p.doc_id JOIN z q ON y = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node)
SELECT node AS doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(root) AS component_id, node = min(root) AS kept FROM r LEFT JOIN z ON z.doc_id = node GROUP BY node
"""


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.later_lines(documents(spark, sf_dir))


@_query
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ``documents`` under stand-in paths; doc_id ends each path."""
    rows = licenses.scan(licenses.document_paths(documents(spark, sf_dir)))
    return rows.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("long"))


@_query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


SQL["op6_mix_sources"] = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), total AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CASE (place - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM total
), levels AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(b.cap) FILTER (WHERE (b.cap / b.w) < (a.cap / a.w)), 0))
    / sum(b.w) FILTER (WHERE (b.cap / b.w) >= (a.cap / a.w)) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.cap, a.w
), goals AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels)) AS target FROM weighed
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0 ELSE g.target / g.source_size END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
    / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@_query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the bits of all rules and the other measurements; ``kept`` is the current policy's verdict."""
    rows = quality.ledger(documents(spark, sf_dir))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.policy_mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       quality.passes().alias("kept"), "fail_bits", "n_lines", "n_upper", "n_letters", "n_marks", "n_other", "n_unspaced")


@_query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


SQL["op8_quality_rules"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum(n) AS BIGINT) AS n_lines FROM (
  SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) GROUP BY r),
pos AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
tri AS (SELECT r, k, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY k) || ' ' || lead(word, 2) OVER (PARTITION BY r ORDER BY k) AS g FROM pos),
rep AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL),
cov AS (SELECT r, count(DISTINCT k + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
  length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS n_other,
  length(regexp_replace(text, '[^\\x{0E00}-\\x{0FFF}\\x{1000}-\\x{10BF}\\x{1780}-\\x{17FF}\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFBF}\\x{20000}-\\x{33FFF}]',
    '', 'g')) AS n_unspaced
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
  + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END + CASE WHEN 3 * n_marks > n_words THEN 64 ELSE 0 END
  + CASE WHEN 2 * n_words + n_unspaced < 100 THEN 128 ELSE 0 END + CASE WHEN 20 * n_symbols > 3 * (2 * n_words + n_unspaced) THEN 256 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars + n_unspaced < 2 * n_words OR 2 * word_chars > 15 * (2 * n_words + n_unspaced)) THEN 512 ELSE 0 END
  + CASE WHEN 2 * n_upper > n_letters + n_other THEN 1024 ELSE 0 END + CASE WHEN 6 * n_marks > 2 * n_words + n_unspaced THEN 2048 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & (1 + 2 + 256 + 8 + 512 + 1024 + 2048) = 0 AS kept,
  CAST(fail_bits AS BIGINT) AS fail_bits, n_lines, n_upper, n_letters, n_marks, n_other, n_unspaced FROM f
"""


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(embeddings(spark, sf_dir))


SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT s.a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY s.a, p ORDER BY score DESC, b) AS INTEGER) AS rank, b AS negative_id,
  ps AS positive_score, score AS negative_score
FROM s JOIN p ON p.a = s.a WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
QUALIFY row_number() OVER (PARTITION BY s.a, p ORDER BY score DESC, b) <= 10
"""


@_query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))
