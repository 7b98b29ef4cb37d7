"""Queries over ordered traversals and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import network as N
from weftgraph.operators import traverse as T
from weftgraph.plans.graph import from_tables, oriented, table
from weftgraph.plans.registry import query
from weftgraph.plans.session import Session
from weftgraph.plans.shared import shared_folder

_THREE = "p_partkey % 3 = 0"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, root): parts as a tree in which each number lies under its half; multiples of 3 by a type of their own."""
    part = table(spark, sf_dir, "part").where("p_partkey > 1")
    ends = F.expr("p_partkey div 2").alias("mine"), F.col("p_partkey").cast("long").alias("other")
    down = part.select(*ends, F.when(F.expr(_THREE), 7).otherwise(3).alias("type_id"), F.lit(1).alias("dir"))
    return down.unionByName(down.select(F.col("other").alias("mine"), F.col("mine").alias("other"), "type_id", F.lit(-1).alias("dir"))), spark.range(1, 2).select(F.col("id").alias("node_id"))


@query("""WITH RECURSIVE t AS (SELECT 1::BIGINT AS node, NULL::BIGINT AS parent, 0 AS depth, [1::BIGINT] AS way UNION ALL SELECT p_partkey, node, depth + 1, list_append(way, p_partkey) FROM t JOIN part ON p_partkey // 2 = node AND p_partkey > 1)
SELECT row_number() OVER (ORDER BY way) AS place, node, parent, depth FROM t""")
def g16_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of halves, all below a part before the next part: 10 levels at 2,000 parts."""
    return N.traversed(*_halves(spark, sf_dir), most_depth=64, order="immediate")


@query("""WITH RECURSIVE kid AS (SELECT p_partkey // 2 AS parent, list({'s': CASE WHEN p_partkey % 3 = 0 THEN -0.5 ELSE -1.0 END, 'd': floor(log2(p_partkey))::INT, 'n': p_partkey}) AS k FROM part WHERE p_partkey > 1 GROUP BY 1),
q AS (SELECT 1::BIGINT AS place, 1::BIGINT AS node, (SELECT list_sort(k) FROM kid WHERE parent = 1) AS queue
  UNION ALL SELECT place + 1, queue[1].n, list_sort(list_concat(queue[2:], coalesce(k, []))) FROM q LEFT JOIN kid ON parent = queue[1].n WHERE len(queue) > 0)
SELECT place, node, CASE WHEN node > 1 THEN node // 2 END AS parent, floor(log2(node))::INT AS depth FROM q""")
def g16_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree in the order of a priority queue: multiples of 3 come by a link of half the score. The SQL takes one part at a time from its queue."""
    return N.traversed(*_halves(spark, sf_dir), most_depth=64, order="ranked", score=F.when(F.col("type_id") == 7, 0.5).otherwise(1.0))


@query("""WITH RECURSIVE t AS (SELECT 1::BIGINT AS node, NULL::BIGINT AS parent, 0 AS depth, [1::BIGINT] AS way UNION ALL SELECT p_partkey, node, depth + 1, list_append(way, p_partkey) FROM t JOIN part ON p_partkey // 2 = node AND p_partkey > 1 WHERE depth < 6 AND node % 7 <> 5 AND node % 11 <> 3)
SELECT row_number() OVER (ORDER BY way) AS place, node, parent, depth FROM t WHERE node % 7 <> 6 AND node % 11 <> 3""")
def g16_preorder_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth first, but some parts are listed and not followed, some followed and not listed, some neither, and one ends the walk with its level."""
    links, root = _halves(spark, sf_dir)
    k = F.col("p_partkey")
    action = F.when(k == 70, "abort").when(k % 11 == 3, "skip").when(k % 7 == 5, "keep").when(k % 7 == 6, "hide")
    actions = table(spark, sf_dir, "part").select(k.cast("long").alias("node_id"), action.alias("action")).where("action IS NOT NULL")
    return N.traversed(links, root, actions, most_depth=64, order="immediate")


@query("""WITH n AS (SELECT n_nationkey::BIGINT * 10 + 2 AS node, n_regionkey::BIGINT * 10 + 1 AS up FROM nation), r AS (SELECT r_regionkey::BIGINT * 10 + 1 AS node FROM region),
few AS (SELECT s_nationkey::BIGINT * 10 + 2 AS up FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY 1 HAVING count(*) < 66),
leaf AS (SELECT c_custkey * 10 + 3 AS node, c_nationkey::BIGINT * 10 + 2 AS up FROM customer UNION ALL SELECT s_suppkey * 10 + 4, s_nationkey::BIGINT * 10 + 2 FROM supplier)
SELECT node, NULL::BIGINT AS parent, 0 AS depth FROM r UNION ALL SELECT node, up, 1 FROM n UNION ALL SELECT node, up, 2 FROM leaf WHERE up IN (SELECT up FROM few)""")
def g16_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with 66 or more customers and suppliers are hubs: listed, but not followed."""
    g = from_tables(spark, sf_dir)
    links = oriented(g.edges.where("type_id = 1"), g.types)
    return N.traversed(links, g.nodes.where("space_id = 1").select("node_id"), most_depth=4, split_at=66).select("node", "parent", "depth")


@query("SELECT row_number() OVER (ORDER BY depth, parent, node) AS place, parent AS mine, node AS other FROM (SELECT p_partkey AS node, p_partkey // 2 AS parent, floor(log2(p_partkey)) AS depth FROM part WHERE p_partkey > 1)")
def g16_linear_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the tree level by level, one for each node, read from its parent."""
    links, root = _halves(spark, sf_dir)
    links = links.withColumn("type_id", F.lit(3))
    return N.listed_edges(links, N.traversed(links, root, most_depth=64), linear=True).select("place", "mine", "other")


# --- sessions ----------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(from_tables(spark, sf_dir), f"{shared_folder(spark)}/session-{uuid.uuid4().hex}")


@query("""WITH e AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey <> 7 UNION SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 5 = 0)
SELECT r::BIGINT * 10 + 1 AS mine, n::BIGINT * 10 + 2 AS other, 1 AS depth, 2 AS calls FROM e
UNION ALL SELECT n::BIGINT * 10 + 2, c_custkey * 10 + 3, 2, 2 FROM e JOIN customer ON c_nationkey = n UNION ALL SELECT n::BIGINT * 10 + 2, s_suppkey * 10 + 4, 2, 2 FROM e JOIN supplier ON s_nationkey = n WHERE s_suppkey % 4 <> 0""")
def g9_overlay_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations move to other regions by transient edges, some edges are removed and a nation is excluded, for this session only; `calls` counts what a second use of a key adds."""
    s = _session(spark, sf_dir)
    edges = s.base.edges.where("type_id = 1")
    moved = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0")
    name = (F.col("n_nationkey").cast("long") * 10 + 2).alias("name1")
    here, there = (F.col("n_regionkey").cast("long") * 10 + 1).alias("name2"), ((F.col("n_regionkey").cast("long") + 1) % 5 * 10 + 1).alias("name2")
    s.remove(moved.select(name, here, F.lit(1).alias("type_id")))
    s.remove(edges.where("name1 % 10 = 4 AND (name1 div 10) % 4 = 0"))
    s.exclude(spark.range(1).select(F.lit(72).alias("node_id")))
    new = moved.select(name, there, F.lit(1).alias("type_id"))
    first = s.transient(new, "moves", authority="session") == moved.count()
    calls = 2 if first and s.transient(new, "moves") == 0 and s.transient(new, "again") == 0 and s.transient(edges, "there", existing=[1]) == 0 else 0
    g = Session(s.base, s.folder).graph()  # opened again
    found = T.expand(oriented(g.edges.where("type_id = 1"), g.types), g.nodes.where("space_id = 1").select("node_id"), recurse=1)
    return found.select("mine", "other", "depth", F.lit(calls).alias("calls"))


@query("""SELECT 'roots' AS what, c_custkey * 10 + 3 AS node_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 10 <> 1
UNION ALL SELECT 'meanwhile', s_suppkey * 10 + 4 FROM supplier UNION ALL SELECT 'reached', o_orderkey * 10 + 6 FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 10 <> 1""")
def g11_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots added, removed, remembered, replaced and recalled; nodes excluded meanwhile are roots no more. Then one hop from them."""
    s = _session(spark, sf_dir)
    customers, suppliers = (s.base.nodes.where(f"space_id = {k}").select("node_id") for k in (3, 4))
    s.add_roots(customers.union(spark.range(1).select(F.lit(-5).cast("long").alias("node_id"))))  # an unknown one is no root
    s.remove_roots(customers.where("(node_id div 10) % 3 = 0"))
    s.remember_roots()
    s.clear_roots()
    s.add_roots(suppliers)
    meanwhile = s.roots().select(F.lit("meanwhile").alias("what"), "node_id")
    s.exclude(customers.where("(node_id div 10) % 10 = 1"))
    s.recall_roots()
    g = s.graph()
    reached = T.expand(oriented(g.edges.where("type_id = 2"), g.types), s.roots()).select(F.lit("reached").alias("what"), F.col("other").alias("node_id"))
    return s.roots().select(F.lit("roots").alias("what"), "node_id").unionByName(meanwhile).unionByName(reached)
