"""The queries over embeddings, secrets and conversations, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, prefix_trie, secret_scan
from .common import table


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.with_inertia(*ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings")))


_NEAREST = """d{n} AS (SELECT r, v, i, list_sum(list_transform(range(1, 65), lambda k: (v[k] - c[k]) * (v[k] - c[k])))::BIGINT AS d FROM vec, c{n}),
a{n} AS (SELECT r, v, i, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, i) = 1),
"""
_MOVED = """e{n} AS (SELECT i, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT i, unnest(v) AS x, unnest(range(1, 65)) AS k FROM a{n}) GROUP BY i, k),
f{n} AS (SELECT i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM e{n} GROUP BY i),
c{m} AS (SELECT c{n}.i, coalesce(f{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN f{n} USING (i)),
"""
OP11_SQL = (
    """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64),
vec AS (SELECT r, vec_id, list_transform(embedding, lambda x: greatest(-67108864, least(67108864, floor(64 * x::DOUBLE)))::BIGINT) AS v FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v AS c FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM vec ORDER BY h, v LIMIT 16)),
"""
    + "".join(_NEAREST.format(n=n) + _MOVED.format(n=n, m=n + 1) for n in range(3))
    + _NEAREST.format(n=3)
    + """own AS (SELECT i, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY i)
SELECT vec_id, i::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a3) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN vec USING (r) JOIN own USING (i) JOIN c3 USING (i)
"""
)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda name: F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    base, live = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: s["verdict"] == "live")
    return found.select(
        F.col("repository").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(secret_scan.told(base), 256).alias("base_sha256"), secret_scan.told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "copied")).cast("long").alias("n_copied"), secret_scan.told(live).alias("live"),
    )


def _op12_kind(k: int, name: str) -> str:
    p = secret_scan.PATTERNS[name].replace("'", "''")
    fits = "len(value) >= 12" if name == "assign" else "true"
    cases = "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')" if name == "blob" else "true"
    return f"""SELECT r, {k} AS kind, '{name}' AS name, stop - len(hit) AS start, stop, value, {fits} AS fits, {cases} AS cases
  FROM (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY r ORDER BY place)::BIGINT AS stop
        FROM (SELECT r, unnest(g[1:len(h)]) AS gap, unnest(h) AS hit, unnest(v) AS value, unnest(range(1, len(h) + 1)) AS place
              FROM (SELECT r, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS h, regexp_extract_all(text, '{p}', {2 if name == "assign" else 0}) AS v FROM d)))"""


_TOLD = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){}, '')"
_OP12_KINDS = "\n  UNION ALL ".join(_op12_kind(k, name) for k, name in enumerate(secret_scan.KINDS))
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
hits AS ({_OP12_KINDS}),
found AS (SELECT *, fits AND cases AND len(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(lower(value), '[a-z]') AND regexp_matches(value, '[0-9]')
          AND NOT regexp_matches(lower(value), '{"|".join(secret_scan.PLACEHOLDERS)}') AS looks FROM hits WHERE fits),
own AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) AS n_owners, count(DISTINCT coalesce('d' || doc_id, '')) AS n_repositories FROM found JOIN d USING (r) GROUP BY value),
judged AS (SELECT *, CASE WHEN n_owners >= 3 OR n_owners > 1 AND n_repositories >= 10 THEN 'copied' WHEN looks THEN 'live' ELSE 'weak' END AS verdict FROM found JOIN own USING (value)),
told AS (SELECT r, count_if(name = 'assign')::BIGINT AS n_assign, count_if(name = 'access')::BIGINT AS n_access, count_if(name = 'hex')::BIGINT AS n_hex, count_if(verdict = 'copied')::BIGINT AS n_copied,
  {_TOLD.format(" FILTER (kind < 3)")} AS base, {_TOLD.format("")} AS spans, {_TOLD.format(" FILTER (verdict = 'live')")} AS live
  FROM judged WHERE kind < 3 OR verdict = 'live' GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(live, '') AS live
FROM d LEFT JOIN told USING (r)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: The unsigned CRC-32 of a number's digits, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * len(c::VARCHAR)), lambda j: (ascii(substr(c::VARCHAR, (j // 8 + 1)::INT, 1))::BIGINT >> (j % 8)) & 1)),
  lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1))), 4294967295::BIGINT)"""
OP13_SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 20 AS g, {_CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
hd AS (SELECT cs.c, t.p, r, x FROM cs JOIN t ON t.c = cs.g AND t.p <= cs.h),
hn AS (SELECT c, count(*) AS n FROM hd GROUP BY c),
rb AS (SELECT * FROM hd UNION ALL SELECT t.c, t.p - cs.h + coalesce(n, 0), r, x FROM t JOIN cs USING (c) LEFT JOIN hn USING (c) WHERE t.p > cs.h),
k AS (SELECT c, p, x, string_agg(len(r) || ':' || len(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY p) AS key FROM rb),
m AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY p) AS up FROM (SELECT c, p, x, key FROM k UNION ALL SELECT c, 0, '', '' FROM cs)),
nd AS (SELECT p AS depth, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(x), '[^\x20\x09-\x0D]+')) AS saved FROM m GROUP BY p, key),
ch AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY ALL),
fin AS (SELECT p AS depth, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT *, max(p) OVER (PARTITION BY c) AS last FROM m) WHERE p = last GROUP BY ALL),
full_ AS (SELECT nd.*, coalesce(n_children, 0) AS n_children, coalesce(ends, sha256('')) AS ends_sha256 FROM nd LEFT JOIN ch USING (depth, key) LEFT JOIN fin USING (depth, key)),
sub AS (SELECT m.p AS depth, m.key, count_if(y.n_children = 0) AS n_leaves, sum(y.saved) AS saved_tokens FROM full_ y JOIN m ON m.c = y.conv_id AND m.p <= y.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, par.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (depth, key) LEFT JOIN full_ par ON par.depth = f.depth - 1 AND par.key = f.up
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op11_ball_kmeans, op12_secret_scan, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op11_ball_kmeans": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_prefix_trie": OP13_SQL}
