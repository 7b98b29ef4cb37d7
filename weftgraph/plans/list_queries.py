"""Queries over lists, scores, names, coordinates and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import intervals as I
from weftgraph.operators import lists as L
from weftgraph.operators import resolve as R
from weftgraph.operators.stretches import numbered
from weftgraph.plans.graph import from_tables, table
from weftgraph.plans.registry import query
from weftgraph.sources import writers as W
from weftgraph.streaming import ingest as G


def _t(spark: SparkSession, sf_dir: str, *names: str):
    got = [table(spark, sf_dir, n) for n in names]
    return got[0] if len(got) == 1 else got


# --- coordinates -----------------------------------------------------------------------------


def _spans(m: DataFrame, side: str) -> DataFrame:
    return m.select(F.col("seq1").alias("seq"), F.col("map_id").alias(f"{side}_id"), F.col("start1").alias(f"{side}_start"), F.col("end1").alias(f"{side}_end"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Backward mappings against forward ones on the same sequence."""
    m = from_tables(spark, sf_dir).mappings
    return _spans(m.where("strand < 0"), "a"), _spans(m.where("strand > 0"), "b")


_PAIRS = "FROM mp a JOIN mp b ON a.seq1 = b.seq1 AND a.strand < 0 AND b.strand > 0"


@query(f"SELECT a.map_id AS a_id, count(*) AS n, min(b.map_id) AS first {_PAIRS} WHERE a.start1 <= b.end1 AND a.end1 >= b.start1 GROUP BY 1", True)
def j9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping(*_two(spark, sf_dir)).groupBy("a_id").agg(F.count("*").alias("n"), F.min("b_id").alias("first"))


@query(f"SELECT a.map_id AS a_id, count(*) AS n {_PAIRS} WHERE b.start1 >= a.start1 AND b.end1 <= a.end1 GROUP BY 1", True)
def j10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.contained(*_two(spark, sf_dir)).groupBy("a_id").agg(F.count("*").alias("n"))


@query(f"SELECT a.map_id AS a_id, b.map_id AS b_id {_PAIRS} WHERE a.start1 = b.start1 AND a.end1 = b.end1", True)
def j11_located_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.located_alike(*_two(spark, sf_dir)).select("a_id", "b_id")


_GAP = "CASE WHEN b.end1 < a.start1 THEN b.end1 - a.start1 WHEN b.start1 > a.end1 THEN b.start1 - a.end1 ELSE 0 END"


@query(f"SELECT a_id, distance, count(*) AS n FROM (SELECT a.map_id AS a_id, {_GAP} AS distance {_PAIRS} WHERE abs({_GAP}) <= 20 QUALIFY rank() OVER (PARTITION BY a.seq1, a.map_id ORDER BY abs({_GAP})) = 1) GROUP BY 1, 2", True)
def j12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest_counts(*_two(spark, sf_dir), within=20).groupBy("a_id", F.col("distance").cast("int").alias("distance")).agg(F.sum("n").alias("n"))


@query(f"SELECT a_id, distance, count(*) AS n FROM (SELECT a.map_id AS a_id, {_GAP} AS distance {_PAIRS} WHERE abs({_GAP}) <= 20 QUALIFY rank() OVER (PARTITION BY a.seq1, a.map_id, sign({_GAP}) ORDER BY abs({_GAP})) = 1) GROUP BY 1, 2", True)
def j12_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest(*_two(spark, sf_dir), within=20, flank=True).groupBy("a_id", "distance").agg(F.count("*").alias("n"))


@query("SELECT map_id, seq1, start1, end1, score FROM mp WHERE score >= 0.7 AND seq1 IN (SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (1, 2)) ORDER BY score DESC, map_id LIMIT 500", True)
def j13_best_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 best mappings with taxa left out: a top list is the operator."""
    m = from_tables(spark, sf_dir).mappings.where("score >= 0.7")
    good = _t(spark, sf_dir, "supplier").where("NOT s_nationkey IN (1, 2)").select(F.col("s_suppkey").alias("seq1"))
    return m.join(good, "seq1", "left_semi").orderBy(F.desc("score"), "map_id").limit(500).select("map_id", "seq1", "start1", "end1", "score")


@query(f"SELECT a.map_id AS a_id, count(*) AS n, round(sum((least(a.end1, b.end1) - greatest(a.start1, b.start1) + 1) / (least(a.end1 - a.start1, b.end1 - b.start1) + 1)), 6) AS coverage {_PAIRS} WHERE a.start1 <= b.end1 AND a.end1 >= b.start1 GROUP BY 1", True)
def i1_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.intersections(*_two(spark, sf_dir)).groupBy("a_id").agg(F.count("*").alias("n"), F.round(F.sum("coverage"), 6).alias("coverage"))


@query("""SELECT p.map_id AS point_id, count(*) AS n, round(sum(CASE WHEN m.strand < 0 THEN m.end2 - off ELSE m.start2 + off END), 4) AS positions
FROM mp p JOIN mp m ON p.seq1 = m.seq1 AND p.start1 BETWEEN m.start1 AND m.end1, LATERAL (SELECT (p.start1 - m.start1) * ((m.end2 - m.start2 + 1) / (m.end1 - m.start1 + 1)) AS off) GROUP BY 1""", True)
def i2_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings
    points = m.select(F.col("map_id").alias("point_id"), F.col("seq1").alias("seq"), F.col("start1").alias("pos"))
    return I.lifted(points, m).groupBy("point_id").agg(F.count("*").alias("n"), F.round(F.sum("pos2"), 4).alias("positions"))


@query("""SELECT seq2, count(*) AS runs, max(n) AS longest FROM (SELECT seq2, run, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY seq2 ORDER BY start1, end1, map_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, coalesce((abs((start2 - lag(end2) OVER w) - (start1 - lag(end1) OVER w)) > 25)::INT, 1) AS new FROM mp WINDOW w AS (PARTITION BY seq2 ORDER BY start1, end1, map_id))) GROUP BY 1, 2) GROUP BY 1""", True)
def i3_congealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings.select("seq2", F.col("start1").alias("s1"), F.struct("end1", "map_id").alias("e"), "start2", "end2")
    flat = m.select("seq2", "s1", F.col("e.end1").alias("e1"), F.col("e.map_id").alias("id"), F.col("start2").alias("s2"), F.col("end2").alias("e2"))
    return I.congealed(flat, ["seq2"], tie="id").groupBy("seq2").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("SELECT seq1, count(*) AS n, max(end1) AS last, sum(end1 - start1 + 1) AS length, min(start1) AS first FROM mp GROUP BY 1", True)
def i4_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings
    return m.groupBy("seq1").agg(F.count("*").alias("n"), F.max("end1").alias("last"), F.sum(F.col("end1") - F.col("start1") + 1).alias("length"), F.min("start1").alias("first"))


@query("""SELECT a.l_orderkey AS order_id, round(CASE WHEN a.l_quantity <= b.l_quantity THEN a.l_discount * s / a.l_quantity ELSE b.l_discount * s / b.l_quantity END + 1e-9, 2) AS score
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2, LATERAL (SELECT least(a.l_quantity, b.l_quantity) - 1 AS s)""")
def i5_bridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second lines of an order as two mappings that share all but one position."""
    lines = _t(spark, sf_dir, "lineitem")
    a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("qa"), F.col("l_discount").alias("da"))
    b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("qb"), F.col("l_discount").alias("db"))
    score = I.bridge_score(F.col("da"), F.col("qa"), F.col("db"), F.col("qb"), F.least("qa", "qb") - 1)
    return a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("order_id"), score.alias("score"))


@query("""SELECT seq1, cluster, count(*) AS n, min(start1) AS first FROM (SELECT *, sum(new) OVER (PARTITION BY seq1 ORDER BY start1, map_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM
(SELECT *, coalesce((start1 - lag(start1) OVER (PARTITION BY seq1 ORDER BY start1, map_id) > 5)::INT, 1) AS new FROM mp)) GROUP BY 1, 2""", True)
def a15_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.clustered(from_tables(spark, sf_dir).mappings, ["seq1"], "start1", 5, "map_id")
    return m.groupBy("seq1", "cluster").agg(F.count("*").alias("n"), F.min("start1").alias("first"))


@query("SELECT seq1, count(DISTINCT d) AS covered FROM (SELECT seq1, unnest(range(greatest(start1, 500), least(end1, 1500) + 1)) AS d FROM mp) GROUP BY 1", True)
def a13_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings.select("seq1", F.col("start1").alias("start"), F.col("end1").alias("end"))
    return I.coverage(m, ["seq1"], F.lit(500), F.lit(1500))


@query("""SELECT seq1, min(start1) AS "start", max(end1) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY seq1 ORDER BY start1, end1, map_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *,
coalesce((start1 > max(end1) OVER (PARTITION BY seq1 ORDER BY start1, end1, map_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM mp)) GROUP BY seq1, run""", True)
def w5_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(from_tables(spark, sf_dir).mappings.select("seq1", F.col("start1").alias("start"), F.col("end1").alias("end")), ["seq1"])


@query("SELECT min(x) AS low, max(x) AS high FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM (SELECT DISTINCT l_orderkey AS x FROM lineitem WHERE l_returnflag = 'R')) GROUP BY g")
def x16_contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.contiguous(_t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")


# --- conversion and tables ---------------------------------------------------------------------


def _supply(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_partkey").alias("input"), F.col("l_suppkey").alias("output")).agg(F.max("l_discount").alias("score"))


_SUPPLY = "SELECT l_partkey AS input, l_suppkey AS output, max(l_discount) AS score FROM lineitem GROUP BY 1, 2"


@query(f"""SELECT input, n_nationkey::BIGINT AS output, round(max(score * 0.9), 9) AS score FROM ({_SUPPLY}) JOIN supplier ON s_suppkey = output JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def j14_convert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = _t(spark, sf_dir, "lineitem", "supplier")
    first = _supply(lines).select(F.col("input").alias("term_in"), F.col("output").alias("term_out"), "score")
    second = supplier.select(F.col("s_suppkey").alias("term_in"), F.col("s_nationkey").cast("long").alias("term_out"), F.lit(0.9).alias("score"))
    return L.chain([first, second]).select("input", "output", F.round("score", 9).alias("score"))


@query("SELECT DISTINCT n_regionkey::BIGINT AS output, p_brand AS input FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity >= 49")
def j15_sequential_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines, supplier, nation = _t(spark, sf_dir, "part", "lineitem", "supplier", "nation")
    lines = lines.where("l_quantity >= 49")
    hops = part.join(lines, part["p_partkey"] == lines["l_partkey"]).join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return hops.select(F.col("p_brand").alias("input"), F.col("n_regionkey").cast("long").alias("output")).distinct()


@query(f"SELECT * FROM ({_SUPPLY}) QUALIFY rank() OVER (PARTITION BY input ORDER BY score DESC) = 1")
def a5_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.keep_best(_supply(_t(spark, sf_dir, "lineitem")), ["input"])


@query(f"SELECT input, max_by(output, struct_pack(s := score, o := -output)) AS output, max(score) AS score FROM ({_SUPPLY}) GROUP BY input")
def a6_best_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _supply(_t(spark, sf_dir, "lineitem"))
    return rows.groupBy("input").agg(F.max_by("output", F.struct("score", -F.col("output"))).alias("output"), F.max("score").alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders WHERE o_orderstatus = 'P' OR o_totalprice >= 200000")
def f14_score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return L.floor_score(rows, 200000)


@query("SELECT c_custkey AS input, o_orderkey AS output FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def u3_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _t(spark, sf_dir, "orders", "customer")
    rows = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("input"), F.col("o_orderkey").alias("output"))
    return L.with_misses(rows, customer.select(F.col("c_custkey").alias("input")))


@query("SELECT o_custkey AS input, o_orderkey AS output FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def f15_drop_by_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("input"), F.col("o_orderkey").alias("output"), "o_orderpriority")
    return L.by_input(rows, F.col("o_orderpriority") == "1-URGENT", drop=True).select("input", "output")


@query("SELECT l_partkey AS input, l_suppkey AS output FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def f18_no_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supply(_t(spark, sf_dir, "lineitem")).where("input != output").select("input", "output")


@query("SELECT l_partkey AS input, l_suppkey AS output FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 5 GROUP BY 1, 2")
def f17_intersected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = _t(spark, sf_dir, "lineitem", "supplier")
    return _supply(lines).join(supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("output")), "output", "left_semi").select("input", "output")


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS l_returnflag, string_agg(DISTINCT l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber::VARCHAR) AS l_linenumber FROM lineitem GROUP BY 1")
def a7_joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.joined_values(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linenumber"])


@query("SELECT lower(n_name) AS name, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS output FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j16_save_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = _t(spark, sf_dir, "nation", "customer")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("input"), F.col("c_mktsegment").alias("output"))
    return L.saved_to(nation.select(F.lower("n_name").alias("name")), rows, "name", ["output"])


def _order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the ranks of their orders in one list for each priority."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("source"), "o_totalprice")
    return numbered(orders, ["source"], [F.desc("o_totalprice")])


@query("SELECT o_custkey AS target, min(r)::DOUBLE AS rank, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS sources FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) GROUP BY 1")
def a8_collapsed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapsed_ranks(_order_ranks(spark, sf_dir))


@query("SELECT o_custkey AS target, round(avg(r), 6) AS rank FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) GROUP BY 1")
def a8_mean_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapsed_ranks(_order_ranks(spark, sf_dir), "mean").select("target", F.round("rank", 6).alias("rank"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_nationkey, " + ", ".join(f'max(CASE WHEN c_mktsegment = \'{s}\' THEN c_acctbal END) AS "{s}"' for s in _SEGMENTS) + " FROM customer GROUP BY 1")
def a12_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grid(_t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", _SEGMENTS, "c_acctbal")


@query("SELECT rank() OVER (ORDER BY c_nationkey) AS i, value, j FROM (SELECT c_nationkey, j, max(c_acctbal) AS value FROM customer JOIN (SELECT s, rank() OVER (ORDER BY s) AS j FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) ON s = c_mktsegment GROUP BY 1, 2) QUALIFY false UNION ALL SELECT i, max(c_acctbal), j FROM customer JOIN (SELECT s, rank() OVER (ORDER BY s) AS j FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) ON s = c_mktsegment JOIN (SELECT n, rank() OVER (ORDER BY n) AS i FROM (SELECT DISTINCT c_nationkey AS n FROM customer)) ON n = c_nationkey GROUP BY i, j")
def a12_sparse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sparse_matrix(_t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal").select("i", "j", F.col("value"))


@query("SELECT o_orderpriority, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(stddev_samp(x) / avg(x), 6) AS cv, 'pending' AS others FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders) GROUP BY 1")
def a11_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return L.moments(rows, ["o_orderpriority"], "value").select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("cv", 6).alias("cv"), F.array_join("others", ",").alias("others"))


@query("SELECT c_mktsegment AS list, c_custkey AS id, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS rank FROM customer")
def w1_list_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("list"), F.col("c_custkey").alias("id"), "c_acctbal")
    return numbered(rows, ["list"], [F.desc("c_acctbal")]).select("list", "id", "rank")


@query("SELECT space_id, name, row_number() OVER (PARTITION BY space_id ORDER BY upper(regexp_extract(name, '^(\\D*)', 1)), regexp_extract(name, '(\\d+)', 1)::DOUBLE, name) AS place FROM node", True)
def o1_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = from_tables(spark, sf_dir).nodes.select("space_id", "name")
    return numbered(nodes, ["space_id"], X.natural_key(F.col("name")), "place", ties=False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25))")
def o3_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 highest and what ties with them: a top list is the operator."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    least = orders.orderBy(F.desc("o_totalprice")).limit(25).agg(F.min("o_totalprice").alias("least"))  # one row
    return orders.join(F.broadcast(least), F.col("o_totalprice") >= F.col("least")).select("o_orderkey", "o_totalprice")


@query("SELECT seq1, map_id, score FROM mp QUALIFY row_number() OVER (PARTITION BY seq1 ORDER BY score DESC, map_id) <= 3", True)
def w3_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_per_group(from_tables(spark, sf_dir).mappings.select("seq1", "map_id", "score"), ["seq1"], [F.desc("score"), F.col("map_id")], 3)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = _t(spark, sf_dir, "customer", "supplier")
    return customer.select(F.col("c_nationkey").alias("k")).union(supplier.select("s_nationkey")).distinct()


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def u2_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    return k.where("l_returnflag = 'R'").select("k").intersect(k.where("l_quantity = 50").select("k")).subtract(k.where("l_quantity = 1").select("k"))


@query("SELECT c_custkey AS term, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS \"1-URGENT\", max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS \"2-HIGH\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def u4_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    sets = orders.select(F.col("o_orderpriority").alias("set_name"), F.col("o_custkey").alias("term"), F.col("o_totalprice").alias("score"))
    return L.membership(customer.select(F.col("c_custkey").alias("term")), sets, ["1-URGENT", "2-HIGH"])


@query("SELECT k, max(score) AS score, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM (SELECT * FROM (SELECT l_partkey AS k, l_discount AS score, 'A' AS source FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_discount, 'R' FROM lineitem WHERE l_returnflag = 'R') QUALIFY rank() OVER (PARTITION BY k ORDER BY score DESC) = 1) GROUP BY k")
def u6_merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("source"))
    return L.merged_results(rows.where("source = 'A'"), rows.where("source = 'R'"), "k")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring')")
def m3_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where(L.has_all_words(F.col("p_name"), "Red ring")).select("p_partkey", "p_name")


@query("SELECT name AS term, site, replace(template, '__ACC__', name) AS url FROM node JOIN (VALUES (1, 'atlas', 'https://atlas.example/__ACC__'), (2, 'atlas', 'https://atlas.example/n/__ACC__'), (2, 'facts', 'https://facts.example/?q=__ACC__')) AS t(space, site, template) ON space = space_id", True)
def m5_linkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(1, "atlas", "https://atlas.example/__ACC__"), (2, "atlas", "https://atlas.example/n/__ACC__"), (2, "facts", "https://facts.example/?q=__ACC__")], "space int, site string, template string")
    return W.linkouts(from_tables(spark, sf_dir).nodes.select(F.col("name").alias("term"), F.col("space_id").alias("space")), templates)


@query("SELECT o_custkey * 10 + 3 AS a, l_suppkey * 10 + 4 AS b, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N') THEN 'kept' WHEN bool_or(l_returnflag = 'N') THEN 'added' ELSE 'retired' END AS change FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2")
def m19_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _t(spark, sf_dir, "orders", "lineitem")
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 10 + 3).alias("a"), (F.col("l_suppkey") * 10 + 4).alias("b"), "l_returnflag")
    return L.changes(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'N'"), ["a", "b"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a2_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_brand, p_type, max(p_size) AS length, min(p_name) AS name FROM part GROUP BY 1, 2")
def m14_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("length"), F.min("p_name").alias("name"))


# --- statistics and matching ---------------------------------------------------------------------


@query("""WITH w AS (SELECT count(*) AS world FROM part), d AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), n AS (SELECT count(*) AS n FROM d),
t AS (SELECT p_brand AS term, count(*) AS size, count(d.id) AS hits FROM part LEFT JOIN d ON d.id = p_partkey GROUP BY 1),
x AS (SELECT *, n * size / world AS expected, hits < n * size / world AS under FROM t, w, n),
p AS (SELECT term, sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(world - size + 1) - lgamma(n - i + 1) - lgamma(world - size - n + i + 1) - lgamma(world + 1) + lgamma(n + 1) + lgamma(world - n + 1))) AS p
      FROM (SELECT *, unnest(CASE WHEN under THEN range(0, hits + 1) ELSE range(hits, least(size, n) + 1) END) AS i FROM x) GROUP BY 1)
SELECT term, size, hits, round(expected, 6) AS expected, round(CASE WHEN under THEN -log10(p) ELSE log10(p) END, 6) AS log_p, round(least(0, log10(p) + log10(count(*) OVER ())), 6) AS log_p_all FROM x JOIN p USING (term)""")
def a9_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = _t(spark, sf_dir, "part", "lineitem")
    got = R.enrichment(part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("id")), lines.where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("id")))
    return got.select("term", "size", "hits", *[F.round(c, 6).alias(c) for c in ("expected", "log_p", "log_p_all")])


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS term, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER () AS total FROM part),
s AS (SELECT term, rank, total, row_number() OVER (PARTITION BY term ORDER BY rank) AS i, count(*) OVER (PARTITION BY term) AS size FROM r),
x AS (SELECT term, size, max(i / size - (rank - i) / (total - size)) AS high, min((i - 1) / size - (rank - i) / (total - size)) AS low FROM s GROUP BY 1, 2)
SELECT term, size, round(CASE WHEN high >= -low THEN high ELSE low END, 9) AS es FROM x""")
def a10_running_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    ranked = numbered(part.select(F.col("p_partkey").alias("id"), "p_retailprice"), [], [F.desc("p_retailprice"), F.col("id").asc()], ties=False).select("id", "rank")
    return R.running_enrichment(ranked, part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("id")))


_HITS = "h AS (SELECT DISTINCT p_partkey AS id, p_type AS source, unnest(string_split(upper(p_name), ' ')) AS word, 1.0 / len(list_distinct(string_split(upper(p_name), ' '))) AS score FROM part)"


@query("WITH " + _HITS + ", s AS (SELECT source, count(DISTINCT id) AS ids FROM h GROUP BY 1) SELECT source, word, round(count(DISTINCT id) / any_value(ids), 9) AS freq FROM h JOIN s USING (source) GROUP BY 1, 2 HAVING count(DISTINCT id) / any_value(ids) > 0.12")
def a1_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.word_hits(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_name").alias("text")))
    return R.blacklist(hits, 0.12).select("source", "word", F.round("freq", 9).alias("freq"))


@query("WITH " + _HITS + """, s AS (SELECT source, count(DISTINCT id) AS ids FROM h GROUP BY 1), b AS (SELECT source, word FROM h JOIN s USING (source) GROUP BY 1, 2 HAVING count(DISTINCT id) / any_value(ids) > 0.12),
q AS (SELECT DISTINCT n_nationkey AS query_id, unnest(CASE WHEN n_regionkey < 2 THEN ['RED', 'RING'] WHEN n_regionkey = 2 THEN ['SMALL', 'BOLT', 'XYZ'] ELSE ['HOT'] END) AS word FROM nation),
t AS (SELECT query_id, count(*) AS total FROM q GROUP BY 1), f AS (SELECT query_id, id, word, score FROM q JOIN (SELECT id, word, max(score) AS score FROM h ANTI JOIN b USING (source, word) GROUP BY 1, 2) USING (word)),
g AS (SELECT query_id, id, word, score FROM q JOIN (SELECT id, word, max(score) AS score FROM h SEMI JOIN b USING (source, word) GROUP BY 1, 2) USING (word) SEMI JOIN f USING (query_id, id)),
a AS (SELECT * FROM f UNION ALL SELECT * FROM g ANTI JOIN f USING (query_id, id, word))
SELECT query_id, id, score FROM (SELECT query_id, id, round(sum(score) * count(*) / any_value(total), 6)::DOUBLE AS score FROM a JOIN t USING (query_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def a4_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation = _t(spark, sf_dir, "part", "nation")
    hits = R.word_hits(part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_name").alias("text")))
    asked = nation.select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_regionkey") < 2, "red-ring").when(F.col("n_regionkey") == 2, "Small bolt (xyz)").otherwise("hot").alias("text"))
    return R.resolve(asked, hits, R.blacklist(hits, 0.12))


_RBM = 'p AS (SELECT l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS identity, count(*) AS matched, max(l_tax) AS "similar" FROM lineitem GROUP BY 1, 2)'


@query("WITH " + _RBM + """, r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY identity DESC, matched DESC, "similar" DESC) AS ra, rank() OVER (PARTITION BY b ORDER BY identity DESC, matched DESC, "similar" DESC) AS rb FROM p),
m AS (SELECT a, b, sa, sb FROM r JOIN (SELECT a, list_sort(list(b)) AS sa FROM r WHERE ra = 1 GROUP BY 1) USING (a) JOIN (SELECT b, list_sort(list(a)) AS sb FROM r WHERE rb = 1 GROUP BY 1) USING (b) WHERE ra = 1 AND rb = 1)
SELECT a, b, len(sa)::INT AS n_a, len(sb)::INT AS n_b FROM m QUALIFY count(*) OVER (PARTITION BY sa, sb) = len(sa) * len(sb)""")
def j18_reciprocal_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return R.reciprocal_best(lines.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("identity"), F.count("*").alias("matched"), F.max("l_tax").alias("similar")))


@query("""WITH p AS (SELECT l_partkey AS gene, s_nationkey AS species, l_suppkey AS parent, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY gene, species ORDER BY weight DESC, parent) = 1) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY parent ORDER BY weight DESC, gene) = 1""")
def a16_orthologues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = _t(spark, sf_dir, "lineitem", "supplier")
    pairs = lines.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_partkey").alias("gene"), F.col("s_nationkey").alias("species"), F.col("l_suppkey").alias("parent")).agg(F.sum("l_quantity").alias("weight"))
    return R.collapsed_orthologues(pairs)


# --- scalar functions ---------------------------------------------------------------------------


@query("SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(p_name || '-' || p_brand || ' 0 ' || p_name), '[^A-Z0-9]+'), lambda w: w <> '' AND w <> '0'))), 'string_agg', ' ') AS words FROM part")
def x3_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("-"), "p_brand", F.lit(" 0 "), "p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(X.words(text)), " ").alias("words"))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice * pow(10, 2 - floor(log10(abs(o_totalprice))))) / pow(10, 2 - floor(log10(abs(o_totalprice)))) END, 6) AS price FROM orders")
def x8_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(X.significant(F.col("o_totalprice")), 6).alias("price"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100)::INT || '%' AS discount FROM lineitem")
def x9_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.percent(F.col("l_discount")).alias("discount"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN p_name[1:9] || '...' ELSE p_name END AS name FROM part")
def x10_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", X.shortened(F.col("p_name"), 12).alias("name"))


@query("""SELECT l_orderkey, array_to_string(s[1:2], ', ') || CASE WHEN len(s) > 2 THEN ' +' || (len(s) - 2) ELSE '' END AS suppliers FROM
(SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS s FROM lineitem GROUP BY 1)""")
def x10_shortened_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("s"))
    return lines.select("l_orderkey", X.shortened_list(F.col("s"), 2).alias("suppliers"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def x11_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy MMM dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.any_date(text).alias("day"))


@query("SELECT CASE space_id WHEN 1 THEN 'REGION' WHEN 2 THEN 'NATION' WHEN 3 THEN 'CUSTOMER' WHEN 4 THEN 'SUPPLIER' WHEN 5 THEN 'PART' ELSE 'ORDER' END AS space, count(*) AS n FROM node GROUP BY 1", True)
def x12_guessed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).nodes.groupBy(X.guessed_space(F.col("name")).alias("space")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS t FROM pages""")
def x13_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(X.xml_escaped(F.col("html"))).alias("t"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def x17_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'MT' ELSE p_size::VARCHAR END AS chromosome, CASE WHEN p_partkey % 3 = 0 THEN 'B' || p_size END AS build,
CASE WHEN p_partkey % 3 < 2 THEN split_part(p_name, ' ', 1) ELSE CASE p_size % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrMT' ELSE 'chr0' || p_size END END AS species FROM part""")
def x6_genomic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names, names without a build, and short names with `chr` and leading zeros."""
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    short = F.when(F.col("p_size") % 4 == 0, "X").when(F.col("p_size") % 4 == 1, "MT").otherwise(size)
    long = F.concat(F.substring_index("p_name", " ", 1), F.lit(".chromosome."), short)
    name = F.when(at == 0, F.concat(long, F.lit(".B"), size)).when(at == 1, long).otherwise(F.concat(F.lit("chr"), F.when(short == size, F.concat(F.lit("0"), size)).otherwise(short)))
    parts = X.genomic(name)
    return _t(spark, sf_dir, "part").select("p_partkey", X.chromosome(name).alias("chromosome"), parts["build"].alias("build"), parts["species"].alias("species"))


# --- operations, streams, lines -------------------------------------------------------------------


def _operations(events: DataFrame) -> DataFrame:
    """Events as operations: clicks, views and purchases set, errors and signups kill; a day is a batch."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    set_or_kill = F.when(F.col("event_type").isin("click", "view", "purchase"), "set").otherwise("kill")
    return events.select(day.alias("batch"), F.col("event_id").alias("seq"), set_or_kill.alias("op"), F.concat(F.lit("U#"), F.col("user_id").cast("string")).alias("name1"), F.concat(F.lit("T#"), F.from_json("props", "k int")["k"].cast("string")).alias("name2"), F.lit(1).alias("type_id"), F.lit("web").alias("authority"), F.col("ts").cast("timestamp").alias("at"))


_FOLD = """WITH o AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS batch, event_type IN ('click', 'view', 'purchase') AS live, 'U#' || user_id AS name1, 'T#' || (props::JSON ->> 'k') AS name2 FROM events),
b AS (SELECT name1, name2, batch, bool_or(live) AS live FROM o GROUP BY 1, 2, 3), c AS (SELECT *, lag(live) OVER (PARTITION BY name1, name2 ORDER BY batch) AS was FROM b)
"""


@query(_FOLD + "SELECT name1, name2, arg_max(live, batch) AS live, count_if(was IS DISTINCT FROM live)::INT AS size FROM c GROUP BY 1, 2")
def t3_fold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.folded(_operations(_t(spark, sf_dir, "events"))).select("name1", "name2", "live", "size")


@query(_FOLD + "SELECT name1, count_if(live) AS alive, count(*) AS edges FROM (SELECT name1, name2, arg_max(live, batch) AS live FROM c GROUP BY 1, 2) GROUP BY 1")
def t3_edge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = G.edge_states(G.folded(_operations(_t(spark, sf_dir, "events"))))
    return states.groupBy("name1").agg(F.count_if("live").alias("alive"), F.count("*").alias("edges"))


@query("""SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2
HAVING datediff('day', max(ts)::DATE, DATE '2024-02-15') > CASE WHEN max(CASE WHEN event_type = 'purchase' THEN value END) IS NULL THEN 18 ELSE 16 END""")
def t4_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a purchase has scored grow stale after 16 days, unscored ones after 18."""
    scored = F.max(F.when(F.col("event_type") == "purchase", F.col("value")))
    cached = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("updated"), scored.alias("score"))
    return G.stale(cached, "2024-02-15", 16, redo_null=18).select("user_id", "event_type", F.col("updated").alias("last"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.windowed(_t(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 DAY)::INT, 1) AS new FROM events)) GROUP BY user_id, s""")
def t5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sessions(_t(spark, sf_dir, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT name1, name2, type_id FROM edge WHERE NOT (type_id = 1 AND name2 % 10 = 1) AND type_id = 1", True)
def k2_kill_partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kills with nulls for what may be anything: here every edge into a region."""
    edges = from_tables(spark, sf_dir).edges.where("type_id = 1").select("name1", "name2", "type_id")
    killed = _t(spark, sf_dir, "region").select(F.lit(None).cast("long").alias("name1"), (F.col("r_regionkey").cast("long") * 10 + 1).alias("name2"), F.lit(None).cast("int").alias("type_id"))
    return G.without(edges, killed, ["name1", "name2", "type_id"])


@query("SELECT m.name || chr(9) || 'is a child of' || chr(9) || o.name AS value FROM edge JOIN node m ON m.node_id = name1 JOIN node o ON o.node_id = name2 WHERE type_id = 1", True)
def k7_sif(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = from_tables(spark, sf_dir)
    a, b = (g.nodes.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("name1", "name2"))
    rows = g.edges.where("type_id = 1").join(a, "name1").join(b, "name2")
    return W.sif(rows.select(F.col("name1_name").alias("name1"), F.lit("is a child of").alias("reading"), F.col("name2_name").alias("name2")))


@query("SELECT concat_ws(chr(9), seq1, start1 - 1, end1, 'M' || map_id, least(1000, greatest(0, round(1000 * score / 10)))::INT, CASE WHEN strand < 0 THEN '-' ELSE '+' END) AS value FROM mp", True)
def k10_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = from_tables(spark, sf_dir).mappings
    return W.bed(m.select(F.col("seq1").alias("seq"), F.col("start1").alias("start"), F.col("end1").alias("end"), F.concat(F.lit("M"), F.col("map_id").cast("string")).alias("name"), (F.col("score") / 10).alias("score"), "strand"))


@query("SELECT n_regionkey || chr(9) || string_agg(n_name, chr(9) ORDER BY n_name) AS value FROM nation GROUP BY n_regionkey")
def k9_set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.set_lines(_t(spark, sf_dir, "nation"), "n_regionkey", "n_name")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def k9_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.json_rows(_t(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])
