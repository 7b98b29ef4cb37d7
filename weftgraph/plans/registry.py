"""Registered queries and the SQL that says the same, with the graph's tables as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The graph of weftgraph.plans.graph.from_tables as SQL.
GRAPH = """WITH RECURSIVE
node AS (SELECT r_regionkey::BIGINT * 10 + 1 AS node_id, 'R#' || r_regionkey AS name, 1 AS space_id FROM region UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, 'N#' || n_nationkey, 2 FROM nation
  UNION ALL SELECT c_custkey * 10 + 3, 'C#' || c_custkey, 3 FROM customer UNION ALL SELECT s_suppkey * 10 + 4, 'S#' || s_suppkey, 4 FROM supplier
  UNION ALL SELECT p_partkey * 10 + 5, 'P#' || p_partkey, 5 FROM part UNION ALL SELECT o_orderkey * 10 + 6, 'O#' || o_orderkey, 6 FROM orders),
edge AS (SELECT n_nationkey::BIGINT * 10 + 2 AS name1, n_regionkey::BIGINT * 10 + 1 AS name2, 1 AS type_id, true AS live, 1 AS space_id FROM nation
  UNION ALL SELECT c_custkey * 10 + 3, c_nationkey::BIGINT * 10 + 2, 1, true, 1 FROM customer UNION ALL SELECT s_suppkey * 10 + 4, s_nationkey::BIGINT * 10 + 2, 1, true, 1 FROM supplier
  UNION ALL SELECT o_orderkey * 10 + 6, o_custkey * 10 + 3, 2, o_orderstatus <> 'P', 1 FROM orders
  UNION ALL SELECT l_orderkey * 10 + 6, l_partkey * 10 + 5, 3, bool_or(l_linestatus = 'F'), 1 FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT l_orderkey * 10 + 6, l_suppkey * 10 + 4, 4, bool_or(l_linestatus = 'F'), 2 FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT p_partkey * 10 + 5, nxt * 10 + 5, 5, true, 1 FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL),
ori AS (SELECT name1 AS mine, name2 AS other, type_id, CASE WHEN type_id = 5 THEN 0 ELSE 1 END AS dir, live, space_id FROM edge
  UNION ALL SELECT name2, name1, type_id, CASE WHEN type_id = 5 THEN 0 ELSE -1 END, live, space_id FROM edge),
edge_type AS (SELECT * FROM (VALUES (1, 'is a child of', 'is a parent of'), (2, 'is a member of', 'has member'), (3, 'contains', 'is contained by'), (4, 'is supplied by', 'supplies'), (5, 'is similar to', 'is similar to')) AS t(type_id, forward, backward)),
class AS (SELECT * FROM (VALUES (1, NULL, 'THING'), (2, 1, 'PLACE'), (3, 2, 'REGION'), (4, 2, 'NATION'), (5, 1, 'PARTY'), (6, 5, 'CUSTOMER'), (7, 5, 'SUPPLIER'), (8, 1, 'GOOD'), (9, 8, 'PART'), (10, 1, 'ORDER')) AS t(class_id, parent_id, class_name)),
label AS (SELECT node_id, CASE space_id WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 7 WHEN 5 THEN 9 ELSE 10 END AS class_id FROM node),
hist AS (SELECT l_orderkey * 10 + 6 AS name1, l_partkey * 10 + 5 AS name2, 3 AS type_id, l_returnflag AS authority, bool_or(l_linestatus = 'F') AS live, count(*) AS size, list(DISTINCT l_shipdate) AS dates FROM lineitem GROUP BY 1, 2, 4),
meta AS (SELECT l_orderkey * 10 + 6 AS name1, l_partkey * 10 + 5 AS name2, sum(l_quantity) AS quantity, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
up AS (SELECT name1 AS child, name2 AS parent FROM edge WHERE type_id = 1),
clo AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM up UNION SELECT c.node, u.parent, c.depth + 1 FROM clo c JOIN up u ON u.child = c.ancestor),
mp AS (SELECT l_orderkey * 10 + l_linenumber AS map_id, l_suppkey AS seq1, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS start1, datediff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT AS end1,
  l_partkey AS seq2, l_linenumber * 100 AS start2, l_linenumber * 100 + l_quantity::INT AS end2, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, round(l_discount * 10, 6) AS score FROM lineitem)
"""


def query(sql: str | None = None, graph: bool = False):
    """Registers a query under its function's name; graph: its SQL uses the graph's tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (GRAPH if graph else "") + sql
        return f

    return add
