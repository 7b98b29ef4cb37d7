"""The queries over the training-data tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hidden_markov, jaccard_join, later_queries, license_scan, mixing, quality_ledger, substring_dedup, token_counts, toxicity, url_rules
from .common import table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


_ITEM_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, item FROM dw JOIN bw USING (l, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, 3 * source_size / weight AS full_at, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
         / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM f),
v AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * v.level) AS target FROM w, v)
SELECT doc_id, size, p.source, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size * size
         + greatest(0, least(start + size, CAST(floor(target) AS BIGINT) % source_size) - start) END AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), jaccard_join.Likeness(n=3, part=90))


def _adds(kind: str):
    return lambda n, s: n + F.when(s["kind"] == kind, s["tokens"]).otherwise(0.0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    of = [F.aggregate("sections", F.lit(0.0), _adds(k)).cast("long").alias(f"tokens_{k}") for k in token_counts.KINDS]
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", *of)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"))
    by_host = F.col("rule").isin(*[r.name for r in url_rules.HOST_RULES])
    return judged.select("page_id", "host", "path", F.when(by_host, F.col("rule")).alias("rule"), "verdict", F.when(~by_host, F.col("rule")).alias("pattern"))


OP6_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern_rule END AS pattern, coalesce(v, CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM (SELECT *, CASE WHEN regexp_matches(host || path, '(?:^|[.-])spam-farm\.') THEN 'spam-farm' WHEN regexp_matches(host || path, '(?:^|[./-])malware(?:[./-]|$)') THEN 'malware'
                     WHEN regexp_matches(host || path, '(?:^|[.-])link-farm\.') THEN 'link-farm' WHEN regexp_matches(host || path, '(?:^|[./-])casino(?:[./-]|$)') THEN 'casino' END AS pattern_rule FROM u)
LEFT JOIN best USING (page_id)
"""


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), "license", F.round("dice", 6).alias("dice"))


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_ledger.passes("base")).alias("base_failed"), quality_ledger.passes("v1").alias("kept"), "failed")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words
      FROM n LEFT JOIN p USING (doc_id)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT)
             + 8 * CAST(n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines AS BIGINT) + 16 * CAST(10 * n_upper > 7 * word_chars AS BIGINT) + 32 * CAST(word_chars > 25 * n_words AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_mix_sources, op3_substring_dedup, op4_jaccard_join, op5_token_counts, op6_url_rules, op7_hidden_markov, op8_toxicity, op9_license_scan, op10_quality_ledger)
} | later_queries.QUERIES
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_url_rules": OP6_SQL, "op10_quality_ledger": OP10_SQL} | later_queries.ORACLE_SQL
