"""Queries over keyed stores: drops of set and kill operations, what is refused, previews."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.graph import table
from weftgraph.plans.list_queries import _operations
from weftgraph.plans.registry import query
from weftgraph.plans.shared import shared_folder
from weftgraph.streaming import store as S


def _named(letter: str, key: str) -> Column:
    return F.concat(F.lit(f"{letter}#"), F.col(key).cast("string"))


def _op(op: str, override: bool = False) -> list[Column]:
    return [F.lit(op).alias("op"), F.lit(override).alias("override")]


_TWO = """WITH o AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS d, event_type IN ('click', 'view', 'purchase') AS live, 'U#' || user_id AS name1, 'T#' || (props::JSON ->> 'k') AS name2, ts FROM events),
b AS (SELECT name1, name2, d, bool_or(live) AS live, coalesce(max(ts) FILTER (WHERE live), max(ts)) AS at_ FROM o GROUP BY 1, 2, 3), c AS (SELECT *, lag(live) OVER (PARTITION BY name1, name2 ORDER BY d) AS was FROM b)
SELECT name1, name2, arg_max(live, d) AS live, count_if(was IS DISTINCT FROM live)::INT AS size, max(at_) FILTER (WHERE was IS DISTINCT FROM live) AS changed FROM c GROUP BY 1, 2"""


@query(_TWO)
def t1_two_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations in two drops of files, each merged into the partitions of the history that it touches."""
    folder = f"{shared_folder(spark)}/drops-{uuid.uuid4().hex}"
    ops = _operations(table(spark, sf_dir, "events"))
    store, kind = S.fresh(spark), S.KINDS["edge"]
    for drop in (F.col("at") < "2024-01-16", F.col("at") >= "2024-01-16"):
        ops.where(drop).select("op", F.lit(False).alias("override"), *kind.names).write.mode("append").json(f"{folder}/in", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        S.ingest(spark, f"{folder}/in", store, kind, f"{folder}/state").awaitTermination()
    return S.read(spark, store, kind).select("name1", "name2", "live", "size", F.element_at("dates", -1).cast("timestamp_ntz").alias("changed"))


def _class_drops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers get the class of their segment and are buyers; then kills for one name, for an authority, of a class and what is below it, and two that are refused."""
    customer = table(spark, sf_dir, "customer")
    name, by = _named("C", "c_custkey").alias("name"), F.concat(F.lit("A"), (F.col("c_nationkey") % 3).cast("string")).alias("authority")
    nothing = F.lit(None).cast("string")
    buyer, ninth = F.lit("BUYER").alias("class_name"), F.lit("A9").alias("authority")
    first = customer.select(*_op("set"), name, F.col("c_mktsegment").alias("class_name"), by).union(customer.select(*_op("set"), name, buyer, ninth))
    classes = spark.createDataFrame([("VEHICLES", "AUTOMOBILE"), ("VEHICLES", "MACHINERY")], "parent string, class_name string")
    one = spark.range(1)
    below = S.deep(one.select(*_op("kill", True), nothing.alias("name"), F.lit("VEHICLES").alias("class_name"), F.lit("A1").alias("authority")), classes)
    second = [
        one.select(*_op("kill", True), nothing.alias("name"), F.lit("BUILDING").alias("class_name"), F.lit("A0").alias("authority")),
        below,
        customer.where("c_custkey % 5 = 0").select(*_op("kill"), name, nothing.alias("class_name"), ninth),
        customer.where("c_custkey % 35 = 0").select(*_op("set"), name, buyer, ninth),
        customer.where("c_custkey % 11 = 0").select(*_op("kill"), name, F.col("c_mktsegment").alias("class_name"), nothing.alias("authority")),
        customer.where("c_custkey % 13 = 0").select(*_op("set"), name, nothing.alias("class_name"), ninth),
    ]
    for more in second[1:]:
        second[0] = second[0].union(more)
    return first, second[0]


_CLASSES = """WITH a AS (SELECT 'C#' || c_custkey AS name, c_custkey AS k, c_mktsegment AS class_name, 'A' || (c_nationkey % 3) AS authority FROM customer UNION ALL SELECT 'C#' || c_custkey, c_custkey, 'BUYER', 'A9' FROM customer)
"""


@query(_CLASSES + """SELECT name, class_name, authority FROM a WHERE NOT (class_name = 'BUILDING' AND authority = 'A0') AND NOT (class_name IN ('AUTOMOBILE', 'MACHINERY') AND authority = 'A1') AND NOT (authority = 'A9' AND k % 5 = 0 AND k % 35 <> 0)""")
def k1_class_set_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, kind = S.fresh(spark), S.KINDS["class"]
    for drop in _class_drops(spark, sf_dir):
        S.apply(spark, store, kind, drop)
    return S.read(spark, store, kind)


@query("SELECT 'kill' AS op, 'too little given' AS why, count(*) AS n FROM customer WHERE c_custkey % 11 = 0 GROUP BY ALL UNION ALL SELECT 'set', 'incomplete', count(*) FROM customer WHERE c_custkey % 13 = 0 GROUP BY ALL")
def k1_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drop refuses, by reason; the rest of it is applied."""
    store, kind = S.fresh(spark), S.KINDS["class"]
    _, refused = S.apply(spark, store, kind, _class_drops(spark, sf_dir)[1])
    return refused.groupBy("op", "why").agg(F.count("*").alias("n"))


@query(_CLASSES + """SELECT effect, count(*) AS n, sum(n_rows)::BIGINT AS n_rows FROM (
SELECT CASE WHEN c > 0 THEN 'removes' ELSE 'nothing' END AS effect, c AS n_rows FROM (SELECT count_if(class_name = 'BUILDING' AND authority = 'A0') AS c FROM a UNION ALL SELECT count_if(class_name = x AND authority = 'A1') FROM a, (VALUES ('VEHICLES'), ('AUTOMOBILE'), ('MACHINERY')) t(x) GROUP BY x)
UNION ALL SELECT CASE WHEN k % 5 = 0 THEN 'removes' END, 1 FROM a WHERE authority = 'A9' AND k % 5 = 0 UNION ALL SELECT 'held', 1 FROM a WHERE authority = 'A9' AND k % 35 = 0
UNION ALL SELECT 'refused', 0 FROM a WHERE authority = 'A9' AND k % 11 = 0 UNION ALL SELECT 'refused', 0 FROM a WHERE authority = 'A9' AND k % 13 = 0) GROUP BY 1""")
def k5_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second drop would do, by effect; nothing is done."""
    store, kind = S.fresh(spark), S.KINDS["class"]
    first, second = _class_drops(spark, sf_dir)
    S.apply(spark, store, kind, first)
    return S.preview(spark, store, kind, second).groupBy("effect").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))


@query("""SELECT 'P#' || p_partkey AS name, max(CASE WHEN p_partkey % 6 <> 0 THEN p_size END)::BIGINT AS length, max(CASE WHEN s % 25 NOT IN (0, 3) THEN s % 25 END)::BIGINT AS tax_id
FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) ON l_partkey = p_partkey GROUP BY 1""")
def k1_lengths_and_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of parts, some killed by name alone; taxa of parts by their suppliers, without the one that means none, another one killed."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = _named("P", "p_partkey").alias("name")
    stores = {k: (S.fresh(spark), S.KINDS[k]) for k in ("length", "taxon")}
    lengths = part.select(*_op("set"), name, F.col("p_size").cast("long").alias("length"), F.col("p_brand").alias("authority"))
    killed = part.where("p_partkey % 6 = 0").select(*_op("kill", True), name, F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("authority"))
    tax = (F.col("l_suppkey") % 25).alias("tax_id")
    taxa = lines.select(*_op("set"), _named("P", "l_partkey").alias("name"), tax, F.lit("A").alias("authority")).distinct()
    gone = part.select(*_op("kill"), name, F.lit(3).cast("long").alias("tax_id"), F.lit("A").alias("authority"))
    for k, drops in (("length", (lengths, killed)), ("taxon", (taxa, gone))):
        for drop in drops:
            S.apply(spark, *stores[k], drop)
    length = S.read(spark, *stores["length"]).groupBy("name").agg(F.max("length").alias("length"))
    taxon = S.read(spark, *stores["taxon"]).groupBy("name").agg(F.max("tax_id").alias("tax_id"))
    return part.select(name).join(length, "name", "left").join(taxon, "name", "left")


_MAPPED = "(SELECT DISTINCT l_suppkey AS s, l_partkey AS p, l_returnflag AS a, l_linestatus AS db, l_linenumber * 100 AS b, l_linenumber * 100 + l_quantity::BIGINT AS e FROM lineitem)"


@query(f"SELECT 'S#' || s AS name1, db, count(*) AS n, sum(e - b)::BIGINT AS covered FROM {_MAPPED} WHERE NOT (s % 3 = 0 AND db = 'O' AND a = 'N') AND NOT (s % 4 = 1 AND p % 2 = 0 AND a = 'R') AND NOT (s % 10 = 7 AND db = 'F') GROUP BY 1, 2")
def k2_mapping_kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings killed by name, target library and authority; by both names and authority; and, with override, by name and library."""
    lines = table(spark, sf_dir, "lineitem")
    kind, store = S.KINDS["mapping"], S.fresh(spark)
    start, end = F.col("l_linenumber").cast("long") * 100, F.col("l_linenumber").cast("long") * 100 + F.col("l_quantity").cast("long")
    value = {
        "name1": _named("S", "l_suppkey"), "name2": _named("P", "l_partkey"), "authority": F.col("l_returnflag"), "db": F.col("l_linestatus"), "start1": start, "end1": end, "start2": start, "end2": end,
        "strand": F.lit(1), "score": F.lit(None).cast("double"),
    }
    only = lambda *given: [(value[c] if c in given else F.lit(None).cast(kind.schema[c].dataType)).alias(c) for c in kind.names]
    S.apply(spark, store, kind, lines.select(*_op("set"), *only(*kind.names)).distinct())
    kills = lines.where("l_suppkey % 3 = 0 AND l_linestatus = 'O' AND l_returnflag = 'N'").select(*_op("kill"), *only("name1", "db", "authority"))
    kills = kills.union(lines.where("l_suppkey % 4 = 1 AND l_partkey % 2 = 0 AND l_returnflag = 'R'").select(*_op("kill"), *only("name1", "name2", "authority")))
    kills = kills.union(lines.where("l_suppkey % 10 = 7 AND l_linestatus = 'F'").select(*_op("kill", True), *only("name1", "db")))
    S.apply(spark, store, kind, kills.distinct())
    return S.read(spark, store, kind).groupBy("name1", "db").agg(F.count("*").alias("n"), F.sum(F.col("end1") - F.col("start1")).alias("covered"))
