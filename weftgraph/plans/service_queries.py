"""Queries over network edits, status, membership, conversion ways and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import edges as E
from weftgraph.operators import intervals as I
from weftgraph.operators import lists as L
from weftgraph.operators import network as N
from weftgraph.plans.graph import from_tables, oriented, table, with_reading
from weftgraph.plans.list_queries import _operations
from weftgraph.plans.registry import query
from weftgraph.plans.shared import shared_folder
from weftgraph.sources import readers, writers
from weftgraph.streaming import ingest as G


# --- networks ----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS term, CASE WHEN p_partkey % 3 <> 0 THEN 'live' WHEN m % 3 <> 0 THEN 'replaced' ELSE 'deprecated' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey WHEN m % 3 <> 0 THEN m END AS usable
FROM (SELECT p_partkey, max(p_partkey) OVER (PARTITION BY p_brand, p_size) AS m FROM part)""")
def g31_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part is deprecated; similar parts point to the next one."""
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("term"), (F.col("p_partkey") % 3 != 0).alias("live"))
    pointers = from_tables(spark, sf_dir).edges.where("type_id = 5").select(F.expr("name1 div 10").alias("source"), F.expr("name2 div 10").alias("target"))
    return N.status(terms, pointers)


@query("SELECT name1, name2, type_id FROM edge WHERE type_id = 3 AND NOT EXISTS (FROM meta m WHERE m.name1 = edge.name1 AND m.name2 = edge.name2 AND quantity > 40)", True)
def f13_without_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return N.without_tagged(g.edges.where("type_id = 3"), g.meta, "quantity", F.col("numeric_value") > 40).select("name1", "name2", "type_id")


@query("SELECT name1 AS node_id FROM edge WHERE type_id = 1 AND (name2 // 10) % 4 <> 0 UNION SELECT name2 FROM edge WHERE type_id = 1 AND (name2 // 10) % 4 <> 0", True)
def g18_nodes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that keep an edge after the edges into every fourth place are deleted."""
    e = from_tables(spark, sf_dir).edges.where("type_id = 1")
    return N.without_edges(e, e.where(F.expr("name2 div 10") % 4 == 0))[1]


@query("SELECT DISTINCT o_custkey * 10 + 3 AS name1, l_partkey * 10 + 5 AS name2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def g10_proxied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for their customers: what orders contain becomes what customers do."""
    g = from_tables(spark, sf_dir)
    by = g.edges.where("type_id = 2").select(F.col("name1").alias("node_id"), F.col("name2").alias("proxy"))
    return N.proxied(g.edges.where("type_id = 3").select("name1", "name2"), by, g.nodes)


@query("""WITH n AS (SELECT n_nationkey::BIGINT * 10 + 2 AS node, n_regionkey::BIGINT * 10 + 1 AS parent, n_nationkey % 5 AS a FROM nation),
f AS (SELECT r_regionkey::BIGINT * 10 + 1 AS node, NULL::BIGINT AS parent, 0 AS depth FROM region UNION ALL SELECT node, parent, 1 FROM n WHERE a NOT IN (0, 2)
UNION ALL SELECT c_custkey * 10 + 3, node, 2 FROM customer JOIN n ON node = c_nationkey * 10 + 2 WHERE a > 1 UNION ALL SELECT s_suppkey * 10 + 4, node, 2 FROM supplier JOIN n ON node = s_nationkey * 10 + 2 WHERE a > 1)
SELECT row_number() OVER (ORDER BY depth, parent NULLS FIRST, node) AS place, node, parent, depth FROM f""")
def g16_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the regions down; of the nations some are skipped, some kept but not followed, some hidden."""
    g = from_tables(spark, sf_dir)
    at = F.expr("node_id div 10") % 5
    actions = g.nodes.where("space_id = 2").select("node_id", F.when(at == 0, "skip").when(at == 1, "keep").when(at == 2, "hide").alias("action")).where("action IS NOT NULL")
    roots = g.nodes.where("space_id = 1").select("node_id")
    return N.traversed(oriented(g.edges.where("type_id = 1"), g.types), roots, actions, most_depth=2)


@query("SELECT l_partkey AS node_id, c AS class_id, n AS score FROM (SELECT l_partkey, l_suppkey % 7 AS c, count(*) + CASE WHEN l_suppkey % 7 = 3 THEN 5 ELSE 0 END AS n FROM lineitem GROUP BY 1, 2, l_suppkey % 7 = 3) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, c) = 1")
def a14_representative_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), (F.col("l_suppkey") % 7).alias("class_id"))
    return N.representative_class(labels, spark.createDataFrame([(3,)], "class_id long"))


@query("SELECT type_id, forward, backward, n FROM edge_type LEFT JOIN (SELECT type_id, count(*) AS n FROM edge GROUP BY 1) USING (type_id)", True)
def sc8_types_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return g.types.join(g.edges.groupBy("type_id").agg(F.count("*").alias("n")), "type_id", "left")


@query("SELECT n_nationkey AS tax_id FROM nation WHERE upper(n_name) LIKE 'NATION_1%'")
def sc9_taxa_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No name fits, so the aliases decide."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tax_id"), F.lit(None).cast("int").alias("merged_id"), F.concat(F.lit("x"), "n_name").alias("name"), F.col("n_name").alias("alias"))
    return readers.taxa_named(names, "nation?1%")


@query("SELECT m.name AS name1, t.forward AS reading, o.name AS name2 FROM edge JOIN node m ON m.node_id = name1 JOIN node o ON o.node_id = name2 JOIN edge_type t USING (type_id) WHERE type_id = 1", True)
def k8_network_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a flat file, and read again."""
    g = from_tables(spark, sf_dir)
    rows = with_reading(oriented(g.edges.where("type_id = 1"), g.types).where("dir = 1"), g.types)
    named = E.named(rows, g.nodes, "mine", "other").select(F.col("mine_name").alias("name1"), "reading", F.col("other_name").alias("name2"))
    path = f"{shared_folder(spark)}/network-{uuid.uuid4().hex}"
    writers.write_lines(writers.network_lines(g.nodes.where("space_id < 5").select("name", F.lit("").alias("value")), named, {"title": "places"}), path)
    return readers.network_file(spark, path)["edges"]


# --- lists ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'")
def f16_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_evidence(table(spark, sf_dir, "lineitem"), "!N", column="l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size >= 20 AND p_brand <> 'Brand#11' AND p_retailprice < 1200.5")
def f20_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    for x in ("p_size >= 20", "!p_brand = Brand#11", "p_name defined", "p_retailprice < 1200.5"):
        part = part.where(L.predicate(x))
    return part.select("p_partkey")


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def f22_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("empty", F.lit(None).cast("string"))
    return L.chosen_columns(rows, ["state", "empty", "o_orderkey"], {"state": "o_orderstatus"}, prune=True)


@query("""SELECT l_suppkey, count_if(x <= 0.05) AS kept, count_if(x > 0.05) AS weak, count_if(x IS NULL) AS unmeasured, min(CASE WHEN x <= 0.05 THEN x END) AS best
FROM (SELECT l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS x FROM lineitem) GROUP BY 1""")
def f23_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("x"))
    return L.by_threshold(rows, "x", 0.05, "l_suppkey")


@query("SELECT lower(n_name) AS name, p AS places FROM nation LEFT JOIN (SELECT s_nationkey, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS p FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def j17_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    listed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"), F.col("s_suppkey").alias("place"))
    return L.compared(nation.select(F.lower("n_name").alias("name")), listed, "name")


@query("""SELECT c_custkey AS term, max(CASE WHEN n_regionkey = 0 THEN s END) AS "R0", max(CASE WHEN n_regionkey = 1 THEN s END) AS "R1", max(CASE WHEN n_nationkey = 1 THEN s END) AS "N1"
FROM (SELECT c_custkey, n_nationkey, n_regionkey, CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE c_acctbal END AS s FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1""")
def m9_deep_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are in the sets of their nations, some unscored, and so in those of the regions."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    sets = customer.select(name("N", "c_nationkey").alias("set_name"), F.col("c_custkey").alias("term"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("score"))
    parents = nation.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent"))
    return L.deep_membership(customer.select(F.col("c_custkey").alias("term")), sets, parents, ["R0", "R1", "N1"])


@query(""", place AS (SELECT DISTINCT o_orderkey AS input, c_nationkey::BIGINT * 10 + 2 AS output FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT l_orderkey, n_regionkey::BIGINT * 10 + 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
top AS (SELECT *, (output // 10) % 2 AS score FROM place QUALIFY rank() OVER (PARTITION BY input ORDER BY (output // 10) % 2 DESC) = 1)
SELECT input, max(score)::DOUBLE AS score, string_agg(output::VARCHAR, ', ' ORDER BY output::VARCHAR) AS terms FROM top p WHERE NOT EXISTS (FROM top q JOIN up ON up.child = q.output WHERE q.input = p.input AND up.parent = p.output) GROUP BY 1""", True)
def m11_best_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the places of odd numbers, if any, as their best terms."""
    orders, customer, lines, supplier, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier", "nation"))
    of_nation = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("input"), (F.col("c_nationkey").cast("long") * 10 + 2).alias("output"))
    of_region = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_orderkey").alias("input"), (F.col("n_regionkey").cast("long") * 10 + 1).alias("output"))
    rows = of_nation.union(of_region).distinct().withColumn("score", (F.expr("output div 10") % 2).cast("double"))
    up = from_tables(spark, sf_dir).edges.where("type_id = 1").select(F.col("name1").alias("child"), F.col("name2").alias("parent"))
    return L.best_terms(rows, up)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions between parts, suppliers, nations and regions, and a longer way round by brands."""
    lines, supplier, nation, part = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation", "part"))

    def rule(df: DataFrame, a: str, b: str, term_in: str, term_out: str, score: float) -> DataFrame:
        pairs = df.select(F.col(term_in).alias("term_in"), F.col(term_out).alias("term_out")).distinct()  # as they are: names of spaces and texts of keys would make rows four times as wide
        return pairs.select(F.lit(a).alias("space_in"), F.lit(b).alias("space_out"), F.col("term_in").cast("string").alias("term_in"), F.col("term_out").cast("string").alias("term_out"), F.lit(score).alias("score"))

    some = rule(lines, "PART", "SUPPLIER", "l_partkey", "l_suppkey", 0.9), rule(supplier, "SUPPLIER", "NATION", "s_suppkey", "s_nationkey", 0.8), rule(nation, "NATION", "REGION", "n_nationkey", "n_regionkey", 0.5), rule(part, "PART", "BRAND", "p_partkey", "p_brand", 1.0)
    return some[0].union(some[1]).union(some[2]).union(some[3])


@query("SELECT DISTINCT l_partkey::VARCHAR AS input, n_regionkey::VARCHAR AS output, round(0.9 * 0.8 * 0.5, 9)::DOUBLE AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_partkey % 2 = 0")
def j14_found_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts to regions, by the way that the rules leave."""
    terms = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("term"))
    return L.converted(terms, _rules(spark, sf_dir), "PART", "REGION").select("input", "output", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE r AS (SELECT * FROM (VALUES ('PART', 'SUPPLIER'), ('SUPPLIER', 'NATION'), ('NATION', 'REGION'), ('PART', 'BRAND')) AS t(a, b)),
c AS (SELECT a, b, 1 AS d FROM r UNION ALL SELECT c.a, r.b, d + 1 FROM c JOIN r ON r.a = c.b)
SELECT a AS space_in, min(CASE WHEN b = 'NATION' THEN d END) AS "NATION", min(CASE WHEN b = 'REGION' THEN d END) AS "REGION", min(CASE WHEN b = 'BRAND' THEN d END) AS "BRAND" FROM c GROUP BY 1""")
def m6_allowed_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.allowed_conversions(_rules(spark, sf_dir).select("space_in", "space_out").distinct(), ["NATION", "REGION", "BRAND"])


@query("SELECT l_orderkey, l_partkey, l_returnflag AS tag, min(l_linestatus) AS value, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1, 2, 3")
def m15_first_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("value"))
    return L.first_tags(meta, ["l_orderkey", "l_partkey"])


@query("SELECT c_custkey AS term, c_name AS description, n_name AS nation, n_orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def m10_extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms passed through, with a description, their nation and a count where there is one."""
    customer, nation, orders = (table(spark, sf_dir, n) for n in ("customer", "nation", "orders"))
    terms = customer.select(F.col("c_custkey").alias("term"))
    described = customer.select(F.col("c_custkey").alias("term"), F.col("c_name").alias("description"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("term"), F.col("n_name").alias("nation"))
    return L.with_columns_of(terms, "term", described, placed, orders.groupBy(F.col("o_custkey").alias("term")).agg(F.count("*").alias("n_orders")))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 ORDER BY parts DESC, l_suppkey LIMIT 20")
def o5_most_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 suppliers with the most parts: a top list is the operator."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).orderBy(F.desc("parts"), "l_suppkey").limit(20)


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey)) AS place FROM customer")
def o6_random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 7)


# --- coordinates, names, streams -----------------------------------------------------------------


@query(""", one AS (SELECT * FROM mp QUALIFY count(*) OVER (PARTITION BY map_id) = 1) SELECT a_id, count(*) AS n, sum(shared)::BIGINT AS shared, round(sum(s1 + e1), 3) AS near, round(sum(s2 + e2), 3) AS far, round(sum(coverage), 6) AS coverage FROM (
SELECT a_id, hi - lo + 1 AS shared, least(p, q) AS s1, greatest(p, q) AS e1, least(t, u) AS s2, greatest(t, u) AS e2, (hi - lo + 1) / least(ae - as_ + 1, be - bs + 1) AS coverage FROM (
SELECT a.map_id AS a_id, a.start1 AS as_, a.end1 AS ae, b.start1 AS bs, b.end1 AS be, greatest(a.start1, b.start1) AS lo, least(a.end1, b.end1) AS hi,
 a.end2 - (lo - a.start1) * ((a.end2 - a.start2 + 1) / (a.end1 - a.start1 + 1)) AS p, a.end2 - (hi - a.start1) * ((a.end2 - a.start2 + 1) / (a.end1 - a.start1 + 1)) AS q,
 b.start2 + (lo - b.start1) * ((b.end2 - b.start2 + 1) / (b.end1 - b.start1 + 1)) AS t, b.start2 + (hi - b.start1) * ((b.end2 - b.start2 + 1) / (b.end1 - b.start1 + 1)) AS u
FROM one a JOIN one b ON a.seq1 = b.seq1 AND a.strand < 0 AND b.strand > 0 AND a.start1 <= b.end1 AND a.end1 >= b.start1)) GROUP BY 1""", True)
def i1_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the far side of backward mappings of one block over the shared sequence to that of forward ones."""
    m = from_tables(spark, sf_dir).mappings
    m = m.join(m.groupBy("map_id").count().where("count = 1"), "map_id", "left_semi").select(F.col("map_id").alias("id"), F.col("seq1").alias("seq"), F.col("start1").alias("start"), F.col("end1").alias("end"), "seq2", "start2", "end2", "strand")
    got = I.bridged(m.where("strand < 0"), m.where("strand > 0"))
    return got.groupBy("a_id").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"), F.round(F.sum(F.col("s1") + F.col("e1")), 3).alias("near"), F.round(F.sum(F.col("s2") + F.col("e2")), 3).alias("far"), F.round(F.sum("coverage"), 6).alias("coverage"))


@query("SELECT seq2 AS key, md5(string_agg(DISTINCT seq1 || ':' || start1 || ':' || end1, '|' ORDER BY seq1 || ':' || start1 || ':' || end1)) AS place FROM mp GROUP BY 1", True)
def i6_place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings.select(F.col("seq2").alias("key"), F.col("seq1").alias("seq"), F.col("start1").alias("start"), F.col("end1").alias("end"))
    return I.place_key(m, "key").select("key", F.md5("place").alias("place"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'refseq' WHEN 1 THEN 'gi' WHEN 2 THEN 'versioned' ELSE 'other' END AS kind FROM orders")
def x5_accession_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    name = F.when(at == 0, F.concat(F.lit("NM_"), key, F.lit(".2"))).when(at == 1, F.concat(F.lit("gi|"), key)).when(at == 2, F.concat(F.lit("AB"), key, F.lit(".1"))).otherwise(F.concat(F.lit("x-"), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.accession_kind(name).alias("kind"))


@query("SELECT c_custkey, upper(split_part(c_name, '#', 1)) || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'JA' ELSE 'K' END AS author FROM customer")
def x4_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.substring_index("c_name", "#", 1), F.when(F.col("c_custkey") % 2 == 0, ",J.A. Jr.").otherwise(" k"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.author(name).alias("author"))


@query("SELECT p_partkey, round(p_size * 0.5, 1) AS score FROM part")
def x9_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as powers of ten, and back."""
    return table(spark, sf_dir, "part").select("p_partkey", X.from_powered(X.powered(F.col("p_size") * 0.5)).alias("score"))


@query("""WITH o AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS batch, event_type IN ('click', 'view', 'purchase') AS live, 'U#' || user_id AS name1, 'T#' || (props::JSON ->> 'k') AS name2 FROM events)
SELECT name1, name2, bool_or(live) AS live, 1 AS size FROM o GROUP BY 1, 2""")
def t1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operation files in one drop: a stream folds them into a versioned history, where sets come after kills."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    _operations(table(spark, sf_dir, "events")).write.json(f"{folder}/in")
    G.ingest(spark, f"{folder}/in", f"{folder}/store", f"{folder}/state").awaitTermination()
    return G.read_version(spark, f"{folder}/store").select("name1", "name2", "live", "size")
