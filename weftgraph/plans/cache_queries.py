"""Queries over stored indexes and caches, ways of rules, seeded clusters, dumps and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import intervals as I
from weftgraph.operators import lists as L
from weftgraph.operators import resolve as R
from weftgraph.operators import traverse as T
from weftgraph.operators.word_index import WordIndex
from weftgraph.plans.graph import from_tables, oriented, table
from weftgraph.plans.registry import SQL, query
from weftgraph.plans.service_queries import _rules
from weftgraph.plans.shared import shared_folder
from weftgraph.sources import readers, writers
from weftgraph.streaming import store as S


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- names from an index -----------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[WordIndex, DataFrame]:
    """Part names by word, in three taxa of whole sources; and the queries of a4_resolve."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    index = WordIndex(spark, _folder(spark, "words"))
    texts = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_name").alias("text"), (F.length("p_type") % 3).alias("taxon"))
    index.load(1, texts.select("id", "source", "text"))  # replaced below by this taxon's own texts
    for taxon in range(3):
        index.load(taxon, texts.where(F.col("taxon") == taxon).drop("taxon"))
    text = F.when(F.col("n_regionkey") < 2, "red-ring").when(F.col("n_regionkey") == 2, "Small bolt (xyz)").otherwise("hot")
    return index, nation.select(F.col("n_nationkey").alias("query_id"), text.alias("text"))


@query(SQL["a4_resolve"])
def m18_resolve_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a4_resolve, from a stored index of which only the asked buckets are read."""
    index, asked = _indexed(spark, sf_dir)
    return index.resolve(asked)


@query("WITH f AS (" + SQL["a4_resolve"] + """), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM f)
SELECT n_nationkey AS query_id, max(id) FILTER (WHERE n = 1) AS best, max(score) FILTER (WHERE n = 1) > coalesce(max(score) FILTER (WHERE n = 2), -1) AS sure, count(*) FILTER (WHERE n > 1) AS n_others FROM nation LEFT JOIN r ON query_id = n_nationkey GROUP BY 1""")
def m18_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best id for each query, whether no other ties with it, and the others as JSON."""
    index, asked = _indexed(spark, sf_dir)
    others = F.from_json("others", "array<struct<id: long, score: double>>")
    return index.standardised(asked).select("query_id", "best", "sure", F.coalesce(F.size(others), F.lit(0)).cast("long").alias("n_others"))


@query("WITH h AS (SELECT DISTINCT p_partkey AS id, p_type AS source, unnest(string_split(upper(p_name), ' ')) AS word FROM part) SELECT source, word, count(DISTINCT id) AS ids FROM h WHERE word IN ('RED', 'RING', 'SMALL', 'BOLT', 'HOT') AND source NOT IN (SELECT p_type FROM part WHERE length(p_type) % 3 = 2) GROUP BY 1, 2")
def m17_reloaded_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for each word and source after a taxon was loaded anew with nothing: its hits are gone, the others stay."""
    index, asked = _indexed(spark, sf_dir)
    index.load(2, table(spark, sf_dir, "part").where("false").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_name").alias("text")))
    words = spark.createDataFrame([(w,) for w in ("RED", "RING", "SMALL", "BOLT", "HOT")], "word string")
    return index.hits(words).join(words, "word", "left_semi").groupBy("source", "word").agg(F.count_distinct("id").alias("ids"))


# --- conversions -------------------------------------------------------------------------------


def _two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with a second way from parts to regions: brands belong to the region of their last digit."""
    part = table(spark, sf_dir, "part")
    region = (F.substring("p_brand", -1, 1).cast("int") % 5).cast("string")
    short = part.select(F.lit("BRAND").alias("space_in"), F.lit("REGION").alias("space_out"), F.col("p_brand").alias("term_in"), region.alias("term_out"), F.lit(0.4).alias("score")).distinct()
    return _rules(spark, sf_dir).unionByName(short)


_WAYS = """s AS (SELECT DISTINCT l_partkey::VARCHAR AS input, n_regionkey::VARCHAR AS output, 0.9 * 0.8 * 0.5 AS score, 'PART>SUPPLIER>NATION>REGION' AS way FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT DISTINCT p_partkey::VARCHAR AS input, (right(p_brand, 1)::INT % 5)::VARCHAR AS output, 0.4 AS score, 'PART>BRAND>REGION' AS way FROM part),
w AS (SELECT input, output, round(max(score), 9)::DOUBLE AS score, arg_max(way, score) AS way FROM (SELECT * FROM s UNION ALL SELECT * FROM b) GROUP BY 1, 2)"""


@query(f"WITH {_WAYS} SELECT w.* FROM w JOIN part ON p_partkey::VARCHAR = input WHERE p_partkey % 2 = 0")
def j14_best_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts to regions by suppliers and nations (0.36) and by brands (0.4); for each output the better way."""
    terms = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("term"))
    found = L.converted_best(terms, _two_ways(spark, sf_dir), "PART", "REGION")
    return found.select("input", "output", F.round("score", 9).alias("score"), F.array_join("way", ">").alias("way"))


@query(f"""WITH {_WAYS}, k AS (SELECT p_partkey::VARCHAR AS term_in, CASE WHEN p_partkey % 4 = 0 THEN DATE '2023-01-01' ELSE DATE '2024-02-01' END AS day, p_partkey % 6 = 1 AS empty FROM part)
SELECT term_in, CASE WHEN p_fresh THEN CASE WHEN empty THEN NULL ELSE 'old' END ELSE output END AS term_out, CASE WHEN p_fresh THEN CASE WHEN empty THEN NULL ELSE 0.1 END ELSE score END AS score, CASE WHEN p_fresh THEN day ELSE DATE '2024-02-15' END AS updated
FROM (SELECT *, datediff('day', day, DATE '2024-02-15') <= CASE WHEN empty THEN 7 ELSE 30 END AS p_fresh FROM k) LEFT JOIN w ON input = term_in AND NOT p_fresh""")
def m8_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of conversions from parts to regions: rows over 30 days old, or unscored ones over 7, are computed anew by the rules, the others stay."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    store, kind = S.fresh(spark), S.CONVERSIONS
    day = F.when(k % 4 == 0, "2023-01-01").otherwise("2024-02-01").cast("timestamp")
    none = k % 6 == 1
    old = part.select(k.cast("string").alias("term_in"), F.lit("PART").alias("ns_in"), F.lit("REGION").alias("ns_out"), F.when(~none, "old").alias("term_out"), F.when(~none, 0.1).alias("score"), day.alias("updated"))
    S.replace(spark, store, kind, range(16), old)
    rules = _two_ways(spark, sf_dir)
    S.churned(spark, store, lambda terms, a, b: L.converted_best(terms, rules, a, b), "2024-02-15", 30, redo_null=7)
    return S.read(spark, store, kind).select("term_in", "term_out", F.round("score", 9).alias("score"), F.col("updated").cast("date").alias("updated"))


@query("""WITH d AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), m AS (SELECT p_brand AS term, p_partkey AS id FROM part UNION ALL SELECT 'SIZE<' || (p_size // 20 * 20 + 20), p_partkey FROM part)
SELECT term, count(*) AS size, count(d.id) AS hits FROM m LEFT JOIN d USING (id) GROUP BY 1 HAVING count(*) <= 0.1 * (SELECT count(*) FROM part)""")
def f21_most_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that more than a tenth of the world has are not tested."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    sizes = part.select(F.concat(F.lit("SIZE<"), F.expr("p_size div 20 * 20 + 20").cast("string")).alias("term"), F.col("p_partkey").alias("id"))
    terms = part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("id")).union(sizes)
    picked = lines.where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return R.enrichment(terms, picked, most_share=0.1).select("term", "size", "hits")


# --- clusters ----------------------------------------------------------------------------------


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS a, nxt AS b FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL AND p_partkey % 11 <> 0),
o AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), w AS (SELECT p_partkey AS node, p_partkey AS seed, 0 AS d FROM part WHERE p_partkey % 7 = 0 UNION SELECT b, seed, d + 1 FROM w JOIN o ON a = node WHERE d < 3 AND b % 11 <> 0)
SELECT node * 10 + 5 AS node, arg_min(seed, d::BIGINT * 1000000000 + seed) * 10 + 5 AS seed, min(d) AS distance FROM w GROUP BY 1""")
def g29_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of similar parts around every seventh part, three edges wide, that enter no multiples of 11."""
    g = from_tables(spark, sf_dir)
    links = oriented(g.edges.where("type_id = 5 AND (name1 div 10) % 11 != 0"), g.types)
    parts = g.nodes.where("space_id = 5")
    return T.seeded(links, parts.where("(node_id div 10) % 7 = 0").select("node_id"), 3, parts.where("(node_id div 10) % 11 != 0").select("node_id"))


# --- scaffolds -----------------------------------------------------------------------------------

_MAPS = """m AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'S' || l_suppkey AS seq1, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS s1, datediff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT AS e1, 'P' || l_partkey AS seq2,
  l_linenumber * 100 AS s2, l_linenumber * 100 + l_quantity::INT AS e2, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, round(l_discount * 10, 6) AS score FROM lineitem),
q AS (SELECT * FROM m WHERE substr(seq1, 2)::INT % 40 = 0),
one AS (SELECT *, greatest(b, s2) AS lo, least(e, e2) AS hi FROM (SELECT q.id AS i1, q.seq1 AS query, q.s1 AS qs, q.e1 AS qe, q.seq2 AS on_, q.s2 AS b, q.e2 AS e, q.strand AS t1, q.score AS sc1, m.* FROM q JOIN m ON m.seq2 = q.seq2 AND m.s2 <= q.e2 AND m.e2 >= q.s2 AND m.id <> q.id AND m.seq1 <> q.seq1)),
r1 AS (SELECT query, seq1 AS seq, CASE WHEN t1 < 0 THEN qe - (hi - b) ELSE qs + (lo - b) END AS st, CASE WHEN t1 < 0 THEN qe - (lo - b) ELSE qs + (hi - b) END AS en, CASE WHEN strand < 0 THEN e1 - (hi - s2) ELSE s1 + (lo - s2) END AS fs, CASE WHEN strand < 0 THEN e1 - (lo - s2) ELSE s1 + (hi - s2) END AS fe, t1 * strand AS strand,
  floor(0.5 + 100 * (CASE WHEN e - b < e2 - s2 THEN sc1 WHEN e - b > e2 - s2 THEN score ELSE least(sc1, score) END * ((hi - lo + 1)::DOUBLE / (least(e - b, e2 - s2) + 1)))) / 100 AS score, [i1, id] AS via, [query, on_, seq1] AS seen FROM one)"""


@query(f"""WITH {_MAPS}, two AS (SELECT r1.query, r1.st, r1.en, r1.fs, r1.fe, r1.strand AS t1, r1.score AS sc1, m.*, greatest(r1.fs, m.s1) AS lo, least(r1.fe, m.e1) AS hi FROM r1 JOIN m ON m.seq1 = r1.seq AND m.s1 <= r1.fe AND m.e1 >= r1.fs AND NOT list_contains(via, m.id) AND NOT list_contains(seen, m.seq2)),
r2 AS (SELECT query, seq2 AS seq, CASE WHEN t1 < 0 THEN en - (hi - fs) ELSE st + (lo - fs) END AS st, CASE WHEN strand < 0 THEN e2 - (hi - s1) ELSE s2 + (lo - s1) END AS fs, hi - lo AS len, t1 * strand AS strand,
  floor(0.5 + 100 * (CASE WHEN fe - fs < e1 - s1 THEN sc1 WHEN fe - fs > e1 - s1 THEN score ELSE least(sc1, score) END * ((hi - lo + 1)::DOUBLE / (least(fe - fs, e1 - s1) + 1)))) / 100 AS score FROM two)
SELECT 1 AS round, query, seq, count(*) AS n, sum(st)::DOUBLE AS starts, sum(fs)::DOUBLE AS far_starts, sum(en - st)::DOUBLE AS lengths, count_if(strand < 0) AS back, round(max(score), 2) AS best FROM r1 GROUP BY 2, 3
UNION ALL SELECT 2, query, seq, count(*), sum(st)::DOUBLE, sum(fs)::DOUBLE, sum(len)::DOUBLE, count_if(strand < 0), round(max(score), 2) FROM r2 GROUP BY 2, 3""")
def g33_two_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every fortieth supplier over shared parts to other suppliers, and on over those to other parts; positions and strands carried over both bridges."""
    lines = table(spark, sf_dir, "lineitem")
    day, length = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")), F.col("l_quantity").cast("int")
    at = F.col("l_linenumber") * 100
    maps = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("map_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seq1"), day.alias("start1"), (day + length).alias("end1"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("seq2"), at.alias("start2"), (at + length).alias("end2"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), F.round(F.col("l_discount") * 10, 6).alias("score"),
    )
    queries = table(spark, sf_dir, "supplier").where("s_suppkey % 40 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("seq"))
    found = I.scaffolded(maps, queries)
    sums = [F.sum(c).alias(n) for c, n in (("start", "starts"), ("far_start", "far_starts"))]
    return found.groupBy("round", "query", "seq").agg(F.count("*").alias("n"), *sums, F.sum(F.col("end") - F.col("start")).alias("lengths"), F.count_if(F.col("strand") < 0).alias("back"), F.round(F.max("score"), 2).alias("best"))


# --- dumps, tables, activities -------------------------------------------------------------------


@query("SELECT page_id, page_id - page_id % 5 AS target, url AS title FROM pages WHERE page_id - page_id % 5 IN (SELECT page_id FROM pages)")
def l22_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a dump and read again: each points to the one before, up to every fifth; titles hold quotes, commas, brackets and backslashes."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "dump")
    title = F.concat(F.lit("it's (a), "), F.coalesce("url", F.lit("")), F.lit("; \\ 'b'"))
    near = F.when(F.col("page_id") % 5 != 0, F.col("page_id") - 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(0).alias("namespace"), title.alias("title"), near.cast("long").alias("redirect"))
    writers.sql_dump_lines(rows, "page").write.option("lineSep", ";\n").text(folder)
    read = readers.sql_dump(spark, folder, "page", "page_id long, namespace int, title string, redirect long")
    known = read.select(F.col("page_id").alias("redirect"))
    ends = T.chased(read.join(known, "redirect", "left_semi").select(F.col("page_id").alias("source"), F.col("redirect").alias("target")))
    named = read.where("namespace = 0").join(ends.select(F.col("source").alias("page_id"), "target"), "page_id", "left").withColumn("target", F.coalesce("target", "page_id")).where("target % 5 = 0")
    head, tail = len("it's (a), "), len("; \\ 'b'")
    return named.select("page_id", "target", F.nullif(F.expr(f"substring(title, {head + 1}, length(title) - {head + tail})"), F.lit("")).alias("title"))


@query("SELECT c_custkey AS k, c_name AS name, 2 AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT n_nationkey, n_name, 3 FROM nation")
def k11_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made, appended to and replaced; all three versions can be read."""
    folder = _folder(spark, "table")
    customer, supplier, nation = (table(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    as_rows = lambda df, k, name: df.select(F.col(k).cast("long").alias("k"), F.col(name).alias("name"))
    writers.write_table(as_rows(customer.where("c_custkey % 2 = 0"), "c_custkey", "c_name"), folder)
    writers.write_table(as_rows(supplier, "s_suppkey", "s_name"), folder, "append")
    writers.write_table(as_rows(nation, "n_nationkey", "n_name"), folder, "drop")
    out = [writers.read_table(spark, folder, v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH a AS (SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 'ic50' WHEN 'A' THEN 'Ki' ELSE 'Shade' END AS e, CASE l_linenumber WHEN 1 THEN 'nM' WHEN 2 THEN 'uM' WHEN 3 THEN '%' ELSE 'furlong' END AS u, CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN -1 ELSE l_quantity END AS v FROM lineitem)
SELECT l_partkey, coalesce(why, 'kept') AS why, count(*) AS n, round(min(CASE WHEN why IS NULL THEN v * CASE u WHEN 'uM' THEN 1000 ELSE 1 END END), 6)::DOUBLE AS best FROM
(SELECT *, CASE WHEN v IS NULL THEN 'no value' WHEN v <= 0 THEN 'no positive number' WHEN e = 'Shade' THEN 'unknown endpoint' WHEN u = 'furlong' THEN 'unknown unit' WHEN u = '%' AND e = 'ic50' THEN 'unit not allowed' END AS why FROM a) GROUP BY 1, 2""")
def l8_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as measured activities: converted to base units where endpoint and unit are allowed, counted by the reason where not."""
    lines = table(spark, sf_dir, "lineitem")
    endpoint = F.when(F.col("l_returnflag") == "R", "ic50").when(F.col("l_returnflag") == "A", "Ki").otherwise("Shade")
    unit = F.when(F.col("l_linenumber") == 1, "nM").when(F.col("l_linenumber") == 2, "uM").when(F.col("l_linenumber") == 3, "%").otherwise("furlong")
    value = F.when(F.col("l_tax") == 0, None).when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_quantity").cast("double"))
    units = spark.createDataFrame([("nm", "nM", 1.0), ("UM", "nM", 1000.0), ("%", "%", 1.0)], "unit string, base string, factor double")
    allowed = spark.createDataFrame([("IC50", "nM"), ("Ki", "nM"), ("Ki", "%")], "endpoint string, base string")
    got = L.activities(lines.select("l_partkey", endpoint.alias("endpoint"), unit.alias("unit"), value.alias("value")), units, allowed)
    return got.groupBy("l_partkey", F.coalesce("why", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"), F.round(F.min("standard"), 6).alias("best"))
