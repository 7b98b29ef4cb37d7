"""Queries over the graph: one-hop edges with filters, hierarchies, walks, paths, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import name_matches
from weftgraph.operators import edges as E
from weftgraph.operators import traverse as T
from weftgraph.plans.graph import SPACES, Graph, from_tables, oriented, read_as, table, with_reading
from weftgraph.plans.registry import query


def _of_class(g: Graph, space: int) -> DataFrame:
    return g.nodes.where(F.col("space_id") == space).select("node_id")


def _up(g: Graph) -> DataFrame:
    return g.edges.where("type_id = 1").select(F.col("name1").alias("child"), F.col("name2").alias("parent"))


def _text(path: str = "path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


_ROW = "SELECT mine, other, type_id, dir, live, space_id FROM ori"


@query("SELECT m.name AS mine_name, o.name AS other_name, t.forward AS reading FROM ori e JOIN node m ON m.node_id = mine JOIN node o ON o.node_id = other JOIN edge_type t USING (type_id) WHERE e.live AND e.space_id = 1 AND m.space_id = 2 AND type_id = 1 AND dir = 1", True)
def j1_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    rows = E.edge_query(g, _of_class(g, 2), reads=["is a child of"])
    return E.named(with_reading(rows, g.types), g.nodes, "mine", "other").select("mine_name", "other_name", "reading")


@query(_ROW + " WHERE live AND space_id = 1 AND type_id = 1 AND mine % 10 = 2", True)
def j1_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 2), reads=["is a child of", "is a parent of"])


@query("SELECT mine, other, CASE WHEN dir < 0 THEN backward ELSE forward END AS reading FROM ori JOIN edge_type USING (type_id) WHERE live AND space_id = 1 AND mine % 10 = 5", True)
def j3_oriented_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return with_reading(E.edge_query(g, _of_class(g, 5)), g.types).select("mine", "other", "reading")


@query(_ROW + " WHERE live AND type_id = 4 AND dir = -1", True)
def f4_reverse_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 4), reads=["supplies"], space=None)


@query("SELECT mine, type_id, dir, count(*) AS n FROM ori WHERE live AND mine % 10 = 6 GROUP BY ALL", True)
def f5_all_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 6), space=None).groupBy("mine", "type_id", "dir").agg(F.count("*").alias("n"))


@query("SELECT mine, count_if(live) AS alive, count_if(NOT live) AS dead FROM ori WHERE space_id = 1 AND type_id = 3 AND dir = -1 GROUP BY mine", True)
def f6_dead_too(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    rows = E.edge_query(g, _of_class(g, 5), reads=["is contained by"], dead_too=True)
    return rows.groupBy("mine").agg(F.count_if("live").alias("alive"), F.count_if(~F.col("live")).alias("dead"))


@query(_ROW + " WHERE live AND type_id = 3 AND dir = 1 AND EXISTS (FROM hist h WHERE h.name1 = mine AND h.name2 = other AND h.live AND authority = 'R')", True)
def f7_keep_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 6), reads=["contains"], keep_authority=["R"])


@query(_ROW + " WHERE live AND type_id = 3 AND dir = 1 AND NOT EXISTS (FROM hist h WHERE h.name1 = mine AND h.name2 = other AND h.live AND authority IN ('N', 'A'))", True)
def f7_toss_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 6), reads=["contains"], toss_authority=["N", "A"])


@query(_ROW + " WHERE live AND space_id = 1 AND mine % 10 = 2 AND other % 10 IN (3, 4)", True)
def f8_keep_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 2), keep_class=["PARTY"])


@query(_ROW + " WHERE live AND space_id = 1 AND mine % 10 = 3 AND other % 10 NOT IN (1, 2)", True)
def f8_toss_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 3), toss_class=["PLACE"])


@query(_ROW + " WHERE live AND space_id = 1 AND mine % 10 = 2 AND other IN (SELECT c_custkey * 10 + 3 FROM customer WHERE c_nationkey IN (1, 2, 3) UNION ALL SELECT s_suppkey * 10 + 4 FROM supplier WHERE s_nationkey IN (1, 2, 3))", True)
def f9_keep_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 2), keep_taxa=[1, 2, 3])


@query(_ROW + " WHERE live AND space_id = 1 AND mine % 10 = 6 AND other % 10 = 3", True)
def f10_keep_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.edge_query(g, _of_class(g, 6), keep_space=[3])


@query(_ROW + " WHERE live AND type_id = 3 AND dir = 1 AND EXISTS (FROM meta m WHERE m.name1 = mine AND m.name2 = other AND quantity > 45 AND flag IN ('R', 'A'))", True)
def f11_tag_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    tags = [E.TagFilter("quantity", F.col("numeric_value") > 45), E.TagFilter("flag", F.col("text_value").isin("R", "A"))]
    return E.edge_query(g, _of_class(g, 6), reads=["contains"], tags=tags)


@query(_ROW + " WHERE live AND type_id = 3 AND dir = -1 AND other IN (SELECT o_orderkey * 10 + 6 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING')", True)
def f12_connects(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    builders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") * 10 + 3).alias("node_id"))
    return E.edge_query(g, _of_class(g, 5), reads=["is contained by"], connects=builders, connects_by=["has member"])


@query("SELECT mine, other, type_id, dir, live, space_id FROM ori WHERE live AND space_id = 1 QUALIFY row_number() OVER (PARTITION BY mine, type_id, dir ORDER BY other) <= 2", True)
def w3_limit_per_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edge_query(from_tables(spark, sf_dir), limit=2)


@query("SELECT e.name1, e.name2, e.type_id FROM edge e WHERE type_id IN (1, 2, 5) AND (name1 // 10) % 3 <> 0 UNION ALL SELECT name1, name2, type_id FROM edge WHERE type_id = 3 AND (name1 // 10) % 3 = 2 AND (name2 // 10) % 2 = 0", True)
def j2_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs either way round, of which a third, moved to another space or number, belong to no edge."""
    g = from_tables(spark, sf_dir)
    at = F.expr("name1 div 10") % 3
    some = g.edges.where("type_id IN (1, 2, 5)").select(F.when(at == 1, F.col("name2")).otherwise(F.col("name1")).alias("a"), F.when(at == 1, F.col("name1")).when(at == 0, -F.col("name2")).otherwise(F.col("name2")).alias("b"))
    more = g.edges.where("type_id = 3").where(at == 2).select(F.col("name2").alias("a"), F.when(F.expr("name2 div 10") % 2 == 0, F.col("name1")).otherwise(F.col("name1") + 100_000_000_000).alias("b"))
    return E.between(g.edges, some.union(more)).select("name1", "name2", "type_id")


@query("SELECT name1, name2, type_id, live, space_id FROM edge WHERE live AND name1 % 10 IN (2, 3) AND name2 % 10 IN (2, 3)", True)
def j8_internal_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return E.connect(g.edges, _of_class(g, 2).union(_of_class(g, 3)))


@query("SELECT name1, name2, type_id, live, space_id FROM edge WHERE name2 % 10 = 2 AND type_id = 1", True)
def sc7_partly_specified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.partly_specified(from_tables(spark, sf_dir).edges, name2=F.pmod("name2", F.lit(10)) == 2, type_id=1)


@query("SELECT node_id, name FROM node WHERE upper(name) LIKE 'C#1%'", True)
def f1_node_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).nodes.where(name_matches(F.col("name"), "c#1%")).select("node_id", "name")


@query("SELECT node_id, name FROM node WHERE name LIKE 'P#_1_'", True)
def f3_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).nodes.where(name_matches(F.col("name"), "P#?1?", heeds_case=True)).select("node_id", "name")


@query("SELECT asked, node_id FROM (SELECT DISTINCT 'c#' || o_custkey AS asked FROM orders UNION SELECT lower(r_name) FROM region) LEFT JOIN node ON upper(name) = upper(asked)", True)
def sc5_bulk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("c#"), F.col("o_custkey").cast("string")).alias("asked")).union(table(spark, sf_dir, "region").select(F.lower("r_name"))).distinct()
    return asked.join(g.nodes.withColumn("key", F.upper("name")), F.upper("asked") == F.col("key"), "left").select("asked", "node_id")


@query("SELECT name1, name2, type_id, false AS live FROM (SELECT DISTINCT c_custkey * 10 + 3 AS name1, s_suppkey * 10 + 4 AS name2, 4 AS type_id FROM customer JOIN supplier ON c_custkey = s_suppkey) UNION ALL SELECT name1, name2, type_id, live FROM edge WHERE type_id = 4", True)
def sc6_add_missing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select((F.col("c_custkey") * 10 + 3).alias("name1"), (F.col("s_suppkey") * 10 + 4).alias("name2"), F.lit(4).alias("type_id"))
    known = g.edges.where("type_id = 4").select("name1", "name2", "type_id", "live")
    return E.add_missing(wanted, known, ["name1", "name2", "type_id"], live=F.lit(False))


@query("SELECT node_id, name FROM node WHERE substr(md5(name), 1, 1) = '0'", True)
def sc10_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixteenth of the nodes, the same each time: sampling is the operator."""
    return from_tables(spark, sf_dir).nodes.where(F.substring(F.md5("name"), 1, 1) == "0").select("node_id", "name")


@query(""", place AS (SELECT DISTINCT o_orderkey AS input, c_nationkey::BIGINT * 10 + 2 AS output FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT l_orderkey, n_regionkey::BIGINT * 10 + 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT input, output FROM place p WHERE NOT EXISTS (FROM place q JOIN up ON up.child = q.output WHERE q.input = p.input AND up.parent = p.output)""", True)
def f19_leaves_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as outputs of orders, the customer's nation and the suppliers' regions: a region goes where it is that nation's."""
    g = from_tables(spark, sf_dir)
    orders, customer, lines, supplier, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier", "nation"))
    of_nation = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("input"), (F.col("c_nationkey").cast("long") * 10 + 2).alias("output"))
    of_region = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_orderkey").alias("input"), (F.col("n_regionkey").cast("long") * 10 + 1).alias("output"))
    return E.leaves_only(of_nation.union(of_region).distinct(), _up(g))


@query("""SELECT type_id, class1, class2, n FROM (SELECT type_id, a.class_id AS class1, b.class_id AS class2, count(*) AS n FROM edge JOIN label a ON a.node_id = name1 JOIN label b ON b.node_id = name2 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY type_id ORDER BY n DESC, class1, class2) = 1""", True)
def g30_schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    a, b = g.labels.select(F.col("node_id").alias("name1"), F.col("class_id").alias("class1")), g.labels.select(F.col("node_id").alias("name2"), F.col("class_id").alias("class2"))
    counts = g.edges.join(a, "name1").join(b, "name2").groupBy("type_id", "class1", "class2").agg(F.count("*").alias("n"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy("type_id").orderBy(F.desc("n"), "class1", "class2"))).where("_n = 1").drop("_n")


@query("SELECT type_id, count(*) AS n, count_if(live) AS alive FROM edge GROUP BY type_id", True)
def a17_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).edges.groupBy("type_id").agg(F.count("*").alias("n"), F.count_if("live").alias("alive"))


@query("SELECT node, ancestor, min(depth) AS depth FROM clo GROUP BY node, ancestor", True)
def g19_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.closure(_up(from_tables(spark, sf_dir)))


@query("WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT node, ancestor // 2, depth + 1 FROM c WHERE ancestor > 1) SELECT node, ancestor, depth FROM c")
def g19_deep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree in which each number lies under its half: 10 levels at 2,000 parts, 14 at 20,000."""
    part = table(spark, sf_dir, "part").where("p_partkey > 1")
    return T.closure(part.select(F.col("p_partkey").cast("long").alias("child"), F.expr("p_partkey div 2").alias("parent")))


@query("SELECT ancestor, count(DISTINCT node) AS children, max(depth) AS deepest FROM clo GROUP BY ancestor", True)
def g20_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.closure(_up(from_tables(spark, sf_dir))).groupBy("ancestor").agg(F.count("*").alias("children"), F.max("depth").alias("deepest"))


@query("""SELECT a, b, CASE WHEN up.depth IS NOT NULL THEN up.depth WHEN down.depth IS NOT NULL THEN -down.depth END AS distance
FROM (SELECT c_custkey * 10 + 3 AS a, n_regionkey::BIGINT * 10 + 1 AS b FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_regionkey::BIGINT * 10 + 1, c_custkey * 10 + 3 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey * 10 + 3, c_custkey * 10 + 4 FROM customer) p
LEFT JOIN clo up ON up.node = a AND up.ancestor = b LEFT JOIN clo down ON down.node = b AND down.ancestor = a""", True)
def g21_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    far = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") * 10 + 3).alias("a"), (F.col("n_regionkey").cast("long") * 10 + 1).alias("b"))
    pairs = far.union(far.select("b", "a")).union(table(spark, sf_dir, "customer").select(F.col("c_custkey") * 10 + 3, F.col("c_custkey") * 10 + 4))
    return T.signed_distance(T.closure(_up(g)), pairs)


@query("""SELECT a, b, ancestor, distance FROM (SELECT a, b, x.ancestor, x.depth + y.depth AS distance FROM (SELECT DISTINCT o_custkey * 10 + 3 AS a, l_suppkey * 10 + 4 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey) p
JOIN clo x ON x.node = a JOIN clo y ON y.node = b AND y.ancestor = x.ancestor) QUALIFY rank() OVER (PARTITION BY a, b ORDER BY distance) = 1""", True)
def g22_common_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 10 + 3).alias("a"), (F.col("l_suppkey") * 10 + 4).alias("b")).distinct()
    return T.common_parents(T.closure(_up(g)), pairs)


@query("SELECT DISTINCT parent AS node FROM up WHERE parent NOT IN (SELECT child FROM up)", True)
def g23_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.roots(_up(from_tables(spark, sf_dir)))


@query("SELECT node, ancestor AS root, depth FROM clo WHERE ancestor NOT IN (SELECT child FROM up)", True)
def g15_tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest parentless ancestor of each node."""
    links = _up(from_tables(spark, sf_dir))
    above = T.closure(links).join(T.roots(links).withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    return above.withColumn("_r", F.rank().over(Window.partitionBy("node").orderBy(F.desc("depth")))).where("_r = 1").select("node", F.col("ancestor").alias("root"), "depth")


@query(", cc AS (SELECT class_id AS node, parent_id AS ancestor, 1 AS depth FROM class WHERE parent_id IS NOT NULL UNION ALL SELECT cc.node, c.parent_id, depth + 1 FROM cc JOIN class c ON c.class_id = cc.ancestor WHERE c.parent_id IS NOT NULL) SELECT node, ancestor, depth FROM cc", True)
def g24_class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.closure(from_tables(spark, sf_dir).classes.select(F.col("class_id").alias("child"), F.col("parent_id").alias("parent")))


@query("""SELECT n_nationkey AS tax_id, n_regionkey + 1000 AS parent_id, 1 AS depth FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, 9999, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END FROM nation UNION ALL SELECT r_regionkey + 1000, 9999, 1 FROM region""")
def g25_shown_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shown_parents(from_tables(spark, sf_dir).taxonomy)


@query("SELECT node, ancestor, depth FROM clo WHERE depth = 2", True)
def g28_bounded_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.closure(_up(from_tables(spark, sf_dir))).where("depth = 2")


def _links(g: Graph, *kinds: int) -> DataFrame:
    return oriented(g.edges, g.types).where(F.col("live") & F.col("type_id").isin(*kinds))


_TWO = """SELECT name2 AS mine, name1 AS other, 1 AS type_id, -1 AS dir, 1 AS depth, {g1} AS grouped FROM edge WHERE type_id = 1 AND name2 % 10 = 1
UNION ALL SELECT name2, name1, 1, -1, 2, {g2} FROM edge WHERE type_id = 1 AND name2 % 10 = 2"""


@query(_TWO.format(g1="false", g2="false"), True)
def g1_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.expand(_links(g, 1), _of_class(g, 1), recurse=2)


@query(_TWO.format(g1="count(*) OVER (PARTITION BY name2) >= 6", g2="count(*) OVER (PARTITION BY name2) >= 6") + " AND name2 IN (SELECT n_nationkey * 10 + 2 FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) < 6))", True)
def g2_expand_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.expand(_links(g, 1), _of_class(g, 1), recurse=2, group_at=6)


@query("SELECT name2 AS mine, name1 AS other, 1 AS type_id, -1 AS dir, 1 AS depth, false AS grouped FROM edge WHERE type_id = 1 AND name2 % 10 = 1", True)
def g4_expand_halted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.expand(_links(g, 1), _of_class(g, 1), recurse=2, halt_nodes=_of_class(g, 2))


@query("""SELECT name1 AS mine, name2 AS other, 1 AS type_id, 1 AS dir, 1 AS depth, false AS grouped FROM edge WHERE type_id = 1 AND name1 % 10 = 4
UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, n_regionkey::BIGINT * 10 + 1, 1, 1, 2, false FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT c_nationkey::BIGINT * 10 + 2, c_custkey * 10 + 3, 1, -1, 2, false FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)""", True)
def g3_expand_same_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.expand(_links(g, 1), _of_class(g, 4), recurse=1, same_taxa=g.taxa)


@query("""SELECT r.r_regionkey::BIGINT * 10 + 1 AS root, o_orderkey * 10 + 6 AS node, concat_ws('>', r_regionkey * 10 + 1, n_nationkey * 10 + 2, c_custkey * 10 + 3, o_orderkey * 10 + 6) AS path
FROM region r JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""")
def g7_explicit_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    walks = T.explicit(_links(g, 1, 2), g.types, _of_class(g, 1), [["is a parent of"], ["is a parent of"], ["has member"]])
    return walks.select("root", "node", _text().alias("path"))


@query("""SELECT legs, count(*) AS n FROM (SELECT 0 AS legs FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 1 FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
UNION ALL SELECT 2 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_linestatus = 'F')) GROUP BY legs""")
def g7_incomplete_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    walks = T.explicit(_links(g, 2, 3), g.types, _of_class(g, 3), [["has member"], ["contains"]], complete=False)
    return walks.groupBy((F.size("path") - 1).alias("legs")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey * 10 + 3 AS root, n_regionkey::BIGINT * 10 + 1 AS node FROM customer JOIN nation ON n_nationkey = c_nationkey")
def g8_telescope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    walks = T.explicit(_links(g, 1), g.types, _of_class(g, 3), [["is a child of"], ["is a child of"]])
    return T.telescope(walks, g.labels, [SPACES[1][1]])


@query("SELECT c_nationkey::BIGINT * 10 + 2 AS root, c_custkey * 10 + 3 AS node FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY length('C#' || c_custkey), 'C#' || c_custkey) = 1")
def g8_telescope_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    walks = T.explicit(_links(g, 1), g.types, _of_class(g, 2), [["is a parent of"]])
    return T.telescope(walks, g.labels, [SPACES[3][1]], g.nodes)


@query("""SELECT r_regionkey::BIGINT * 10 + 1 AS node_id, 0 AS distance FROM region UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, 1 FROM nation UNION ALL SELECT c_custkey * 10 + 3, 2 FROM customer
UNION ALL SELECT s_suppkey * 10 + 4, 2 FROM supplier UNION ALL SELECT o_orderkey * 10 + 6, 3 FROM orders WHERE o_orderstatus <> 'P'""")
def g12_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.distances(_links(g, 1, 2), _of_class(g, 1))


_PATHS = "SELECT concat_ws('>', o_orderkey * 10 + 6, c_custkey * 10 + 3, n_nationkey * 10 + 2, n_regionkey * 10 + 1) AS path, round({}, 9) AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P'"


@query(_PATHS.format("0.95 ** 3"))
def g13_find_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return T.find_paths(_links(g, 1, 2), _of_class(g, 1), _of_class(g, 6)).select(_text().alias("path"), F.round("score", 9).alias("score"))


@query(_PATHS.format("0.9 * 0.8 ** 2"))
def g14_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    weight = F.when(F.col("type_id") == 1, 0.8).otherwise(0.9)
    found = T.find_paths(_links(g, 1, 2), _of_class(g, 1), _of_class(g, 6), weight, slack=1)
    return T.best_paths(found).select(_text().alias("path"), F.round("score", 9).alias("score"))


@query("SELECT p_partkey * 10 + 5 AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_size) * 10 + 5 AS root FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1")
def g29_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.components(from_tables(spark, sf_dir).edges.where("type_id = 5").select(F.col("name1").alias("a"), F.col("name2").alias("b")))


@query("SELECT p_partkey * 10 + 5 AS source, max(p_partkey) OVER (PARTITION BY p_brand, p_size) * 10 + 5 AS target FROM part QUALIFY p_partkey < max(p_partkey) OVER (PARTITION BY p_brand, p_size)")
def g34_pointer_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chased(from_tables(spark, sf_dir).edges.where("type_id = 5").select(F.col("name1").alias("source"), F.col("name2").alias("target")))


@query("""SELECT accession, version, CASE WHEN version = 0 THEN accession ELSE accession || '.' || version END AS name, CASE WHEN version > 1 THEN accession || '.' || (version - 1) WHEN version = 1 THEN accession END AS prior
FROM (SELECT n_name AS accession, unnest(range(0, n_regionkey + 2))::INT AS version FROM nation)""")
def g32_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.versions(table(spark, sf_dir, "nation").select(F.col("n_name").alias("accession"), (F.col("n_regionkey") + 1).alias("version")))


@query("SELECT DISTINCT n_nationkey::BIGINT * 10 + 2 AS node, 'pick' AS pick FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'")
def d6_walk_with_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk as steps over named sets of nodes: from urgent orders to members, and on to their places."""
    g = from_tables(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") * 10 + 6).alias("node_id"))
    links = _links(g, 1, 2)
    members = links.where(read_as(g.types, "is a member of")).join(urgent.withColumnRenamed("node_id", "mine"), "mine", "left_semi").select(F.col("other").alias("node_id")).distinct()
    places = links.where(read_as(g.types, "is a child of")).join(members.withColumnRenamed("node_id", "mine"), "mine", "left_semi")
    return places.select(F.col("other").alias("node"), F.lit("pick").alias("pick")).distinct()


@query("SELECT name1, name2, authority, live, size, len(dates) AS n_dates, list_min(dates) AS first, list_max(dates) AS last FROM hist", True)
def m13_edge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = from_tables(spark, sf_dir).history
    return h.select("name1", "name2", "authority", "live", "size", F.size("dates").cast("long").alias("n_dates"), F.array_min("dates").cast("timestamp_ntz").alias("first"), F.array_max("dates").cast("timestamp_ntz").alias("last"))
