"""Queries over several lists at once, places on a build, normalised names, nested spaces and pivot reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import intervals as I
from weftgraph.operators import lists as L
from weftgraph.operators import names as M
from weftgraph.operators import resolve as R
from weftgraph.operators import traverse as T
from weftgraph.plans.graph import table
from weftgraph.plans.registry import query
from weftgraph.plans.shared import heeding_case


@query("""WITH w AS (SELECT count(*) AS world FROM part), l AS (SELECT 'Q' || q AS list, id, min(r) AS rank FROM (SELECT l_quantity::INT // 10 AS q, l_partkey AS id, l_orderkey AS r FROM lineitem WHERE l_returnflag = 'R' AND l_quantity::INT % 10 = 0 UNION ALL SELECT 9, p_partkey, p_retailprice * 100 FROM part WHERE p_size > 10) GROUP BY 1, 2),
n AS (SELECT list, count(*) AS n, count(*) >= 0.5 * (SELECT world FROM w) AS whole FROM l GROUP BY 1), t AS (SELECT p_brand AS term, count(*) AS size FROM part GROUP BY 1),
h AS (SELECT l.list, p_brand AS term, count(*) AS hits FROM l JOIN n USING (list) JOIN part ON p_partkey = id WHERE NOT whole GROUP BY 1, 2),
x AS (SELECT *, hits < n * size / world AS under FROM h JOIN t USING (term) JOIN n USING (list), w),
p AS (SELECT list, term, log10(sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(world - size + 1) - lgamma(n - i + 1) - lgamma(world - size - n + i + 1) - lgamma(world + 1) + lgamma(n + 1) + lgamma(world - n + 1)))) AS lp
      FROM (SELECT *, unnest(CASE WHEN under THEN range(greatest(0, n + size - world), hits + 1) ELSE range(hits, least(size, n) + 1) END) AS i FROM x) GROUP BY 1, 2),
c AS (SELECT log10((SELECT count(*) FROM t)) AS ct, log10((SELECT count(*) FROM n WHERE NOT whole)) AS cl),
s AS (SELECT list, term, n, place, row_number() OVER (PARTITION BY list, term ORDER BY place) AS i, count(*) OVER (PARTITION BY list, term) AS hits FROM (SELECT list, id, n, row_number() OVER (PARTITION BY list ORDER BY rank, id) AS place FROM l JOIN n USING (list) WHERE whole) JOIN (SELECT p_partkey AS id, p_brand AS term FROM part) USING (id)),
e AS (SELECT list, term, max(hits) AS hits, max(i / hits - (place - i) / greatest(n - hits, 1)) AS high, min((i - 1) / hits - (place - i) / greatest(n - hits, 1)) AS low FROM s GROUP BY 1, 2)
SELECT list, term, 'picked' AS mode, hits, round(CASE WHEN under THEN -lp ELSE lp END, 6) AS log_p, round(least(0, lp + ct), 6) AS log_p_terms, round(least(0, least(0, lp + ct) + cl), 6) AS log_p_lists, NULL::DOUBLE AS es FROM x JOIN p USING (list, term), c
UNION ALL SELECT list, term, 'ranked', hits, NULL, NULL, NULL, round(CASE WHEN high >= -low THEN high ELSE low END, 9) FROM e""")
def a10_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands against lists of parts by quantity, corrected for terms and lists, and against a list of most parts, by its ranks."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    tens = lines.where("l_returnflag = 'R' AND CAST(l_quantity AS INT) % 10 = 0").select(F.expr("'Q' || (CAST(l_quantity AS INT) div 10)").alias("list"), F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("double").alias("rank"))
    most = part.where("p_size > 10").select(F.lit("Q9").alias("list"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 100).alias("rank"))
    got = R.enrichment_of_lists(part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("id")), tens.union(most))
    return got.select("list", "term", "mode", "hits", *[F.round(c, 6).alias(c) for c in ("log_p", "log_p_terms", "log_p_lists")], "es")


_PLACED = "m AS (SELECT l_partkey AS term, 'S' || l_suppkey AS seq, CASE WHEN l_linestatus = 'F' THEN 'B36' ELSE 'B37' END AS build, l_linenumber * 100 AS s, l_linenumber * 100 + l_quantity::INT AS e, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, CASE WHEN l_tax > 0 THEN round(l_discount * 10, 6) END AS score FROM lineitem)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_linenumber") * 100
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("term"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seq"), F.when(F.col("l_linestatus") == "F", "B36").otherwise("B37").alias("build"), at.alias("start"), (at + F.col("l_quantity").cast("int")).alias("end"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 10, 6)).alias("score"),
    )


@query(f"WITH {_PLACED}, h AS (SELECT *, max(score) OVER (PARTITION BY term) AS best FROM m WHERE build = 'B37' AND (score IS NULL OR score >= 0.2)) SELECT term, seq, s AS \"start\", e AS \"end\", score FROM h WHERE best IS NULL OR round(best - score, 9) <= 0.1")
def m1_on_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of parts on one build, scored 0.2 or more and at most 0.1 under the part's best."""
    return I.on_build(_placed(spark, sf_dir), "B37", 0.2, 0.1).select("term", "seq", "start", "end", "score")


@query(f"""WITH {_PLACED} SELECT seq || chr(9) || 'lines' || chr(9) || 'match' || chr(9) || s || chr(9) || e || chr(9) || coalesce(format('{{:.2f}}', score), '.') || chr(9) || CASE WHEN strand < 0 THEN '-' ELSE '+' END || chr(9) || '.' || chr(9) || 'term "' || term || '"' AS value FROM m WHERE build = 'B36'""")
def m20_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.features(I.on_build(_placed(spark, sf_dir), "B36"), "lines", "match")


@query("""WITH a AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'gi|' || l_partkey WHEN 1 THEN 'NM_' || l_partkey || '.' || l_linenumber WHEN 2 THEN 'g:' || l_partkey ELSE 'some ' || l_partkey END AS x, l_partkey AS p, l_linenumber AS v FROM lineitem)
SELECT name1, reading, name2 FROM (SELECT DISTINCT 'gi' || p AS name1, 'is a reliable alias for' AS reading, 'GI:' || p AS name2 FROM a WHERE v % 2 = 0 AND p > 0 UNION ALL SELECT DISTINCT 'GI:' || p, 'is a reliable alias for', 'gi' || p FROM a WHERE v % 2 = 0 AND p > 0
UNION ALL SELECT x, 'is a version of', 'NM_' || p FROM a WHERE v % 4 = 1 UNION ALL SELECT x, 'is the version after', 'NM_' || p || '.' || (v - 1) FROM a WHERE v % 4 = 1 AND v > 1
UNION ALL SELECT DISTINCT n, 'class', 'GI' FROM (SELECT unnest(['gi' || p, 'GI:' || p]) AS n FROM a WHERE v % 2 = 0 AND p > 0) UNION ALL SELECT DISTINCT n, 'class', 'RNA' FROM (SELECT unnest([x, 'NM_' || p]) AS n FROM a WHERE v % 4 = 1))""")
def m16_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and classes that accessions in several forms tell."""
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    form = F.when(n % 4 == 0, F.concat(F.lit("gi|"), p)).when(n % 4 == 1, F.concat(F.lit("NM_"), p, F.lit("."), n.cast("string"))).when(n % 4 == 2, F.concat(F.lit("g:"), p)).otherwise(F.concat(F.lit("some "), p))
    edges, labels = M.normalised(table(spark, sf_dir, "lineitem").select(form.alias("accession")))
    return edges.unionByName(labels.select(F.col("name").alias("name1"), F.lit("class").alias("reading"), F.col("class_name").alias("name2")))


@query("WITH s AS (SELECT c_mktsegment AS space, 'N' || c_nationkey AS up, c_custkey FROM customer) SELECT n_regionkey::VARCHAR AS space, count(DISTINCT up || '/' || s.space) + count(DISTINCT up) AS below, count(*) AS names FROM s JOIN nation ON up = 'N' || n_nationkey GROUP BY 1")
def g26_nested_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names lie in spaces by segment, these in spaces by nation, these by region: how many spaces are below a region, and the names in all of them."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    by_nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    held = customer.select(F.concat_ws("/", by_nation, F.col("c_mktsegment")).alias("space"), by_nation.alias("up"))
    nested = held.select(F.col("space").alias("child"), F.col("up").alias("parent")).union(nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.col("n_regionkey").cast("string"))).distinct()
    above = T.closure(nested)
    regions = nation.select(F.col("n_regionkey").cast("string").alias("ancestor")).distinct()
    inside = above.join(regions, "ancestor", "left_semi").join(held.groupBy(F.col("space").alias("node")).agg(F.count("*").alias("n")), "node", "left")
    counts = inside.groupBy(F.col("ancestor").alias("space")).agg(F.count("*").alias("below"), F.sum("n").alias("names"))
    return counts.where("names IS NOT NULL")


@query("""SELECT p_brand AS target, max(CASE WHEN f = 'A' THEN best END) AS "A", max(CASE WHEN f = 'N' THEN best END) AS "N", max(CASE WHEN f = 'R' THEN best END) AS "R", sum(n)::BIGINT AS n, round(max(mean), 6) AS mean_of_best FROM
(SELECT p_brand, l_returnflag AS f, max(l_discount) AS best, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 25 GROUP BY 1, 2) JOIN (SELECT p_brand, avg(m) AS mean FROM (SELECT p_brand, p_partkey, max(l_discount) AS m FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 25 GROUP BY 1, 2) GROUP BY 1) USING (p_brand) GROUP BY 1""")
def m12_pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds (parts) by target (brand): the best value of each kind of assay, how many there are, and the mean of the compounds' best.

    The column of kind `N` and the count `n` differ by case alone, so the report is made in a session that heeds case.
    """
    spark = heeding_case(spark)
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity >= 25")
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("target"), "p_partkey", F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("value"))
    return L.pivot_report(rows, "target", "p_partkey", "kind", "value", ["A", "N", "R"])


@query("SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12') AS \"first\", p_size > 40 AS \"large\", CASE WHEN p_size > 40 THEN 'size ' || p_size END AS large_note FROM part")
def u5_set_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns for sets of one's own, and what a set says of its members."""
    part = table(spark, sf_dir, "part")
    sets = part.where("p_brand IN ('Brand#11', 'Brand#12')").select(F.lit("first").alias("set_name"), F.col("p_partkey").alias("term"), F.lit(None).cast("string").alias("note"))
    sets = sets.union(part.where("p_size > 40").select(F.lit("large"), "p_partkey", F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    return L.custom_sets(part.select("p_partkey"), sets, "p_partkey", {"first": False, "large": True})
