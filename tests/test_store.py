"""Keyed stores and sessions: what a drop rewrites, what it leaves, and what readers see."""

import os

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import traverse as T
from weftgraph.plans import graph
from weftgraph.plans.session import Session
from weftgraph.streaming import store as S

SF = "/root/testdata/sf0.001"
CLASS = "op string, override boolean, name string, class_name string, authority string"


def files(folder):
    return {os.path.join(d, n): (os.stat(os.path.join(d, n)).st_mtime_ns, os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(folder) for n in names}


def held(spark, store, kind, version=None):
    return sorted(tuple(r) for r in S.read(spark, store, kind, version).collect())


def test_a_drop_rewrites_only_the_partitions_it_changes(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["class"]
    S.create(spark, store, 8)
    first = [("set", None, f"n{k}", "A", "x") for k in range(200)]
    v1, _ = S.apply(spark, store, kind, spark.createDataFrame(first, CLASS))
    before = files(f"{store}/data")
    v2, _ = S.apply(spark, store, kind, spark.createDataFrame([("set", None, "n3", "B", "x"), ("kill", None, "n3", "A", "x")], CLASS))
    after = files(f"{store}/data")
    assert all(after[f] == before[f] for f in before)
    old, new = S.manifest(spark, store, v1)[1], S.manifest(spark, store, v2)[1]
    assert sum(a != b for a, b in zip(old, new, strict=True)) == 1
    assert held(spark, store, kind, v1) == sorted((f"n{k}", "A", "x") for k in range(200))
    assert held(spark, store, kind) == sorted([(f"n{k}", "B" if k == 3 else "A", "x") for k in range(200)])


def test_what_changes_nothing_makes_no_version(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["class"]
    S.create(spark, store, 4)
    ops = spark.createDataFrame([("set", None, "a", "A", "x"), ("kill", None, "a", "A", "x"), ("set", None, "a", "A", "x")], CLASS)
    v, _ = S.apply(spark, store, kind, ops)  # a kill comes before a set of the same drop
    assert held(spark, store, kind) == [("a", "A", "x")]
    assert S.apply(spark, store, kind, ops)[0] == v and S.versions(spark, store) == [0, v]
    assert S.apply(spark, store, kind, spark.createDataFrame([("kill", True, None, None, "y")], CLASS))[0] == v
    v2, _ = S.apply(spark, store, kind, spark.createDataFrame([("kill", True, None, None, "x")], CLASS))
    assert v2 == v + 1 and held(spark, store, kind) == [] and set(S.manifest(spark, store)[1]) == {None}


def test_operations_that_break_the_rules_are_refused(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["class"]
    S.create(spark, store, 2)
    bad = [("kill", None, "a", None, None), ("kill", None, None, None, "x"), ("kill", True, None, "A", None), ("set", None, "a", None, "x"), ("drop", None, "a", "A", "x"), (None, None, "a", "A", "x")]
    v, refused = S.apply(spark, store, kind, spark.createDataFrame(bad, CLASS))
    assert v == 0 and sorted(r.why for r in refused.collect()) == ["incomplete", "no such operation", "no such operation", "too little given", "too little given", "too little given"]
    length = S.checked(spark.createDataFrame([("set", None, "a", -1, "x"), ("set", None, "a", 0, "x")], "op string, override boolean, name string, length long, authority string"), S.KINDS["length"])
    assert sorted(str(r.why) for r in length.collect()) == ["None", "not allowed"]
    tax = S.checked(spark.createDataFrame([("set", None, "a", k, "x") for k in (0, 12908, 9606)], "op string, override boolean, name string, tax_id long, authority string"), S.KINDS["taxon"])
    assert [r.why for r in tax.orderBy("tax_id").collect()] == ["not allowed", None, "not allowed"]


def test_old_versions_go_with_the_files_that_no_other_holds(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["class"]
    S.create(spark, store, 4)
    for k in range(4):
        S.apply(spark, store, kind, spark.createDataFrame([("set", None, f"n{j}", f"c{k}", "x") for j in range(40 if k == 0 else 1)], CLASS))
    now, before = held(spark, store, kind), len(files(f"{store}/data"))
    assert S.remove_versions(spark, store, keep=2) == [0, 1, 2]
    assert held(spark, store, kind) == now and len(held(spark, store, kind, 3)) == len(now) - 1 and len(files(f"{store}/data")) < before
    with pytest.raises(ValueError, match="no version"):
        S.read(spark, store, kind, 1)


def test_a_version_that_was_not_written_whole_is_not_read(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["class"]
    S.create(spark, store, 2)
    S.apply(spark, store, kind, spark.createDataFrame([("set", None, "a", "A", "x")], CLASS))
    os.makedirs(f"{store}/manifest/v=2")
    assert S.versions(spark, store) == [0, 1] and held(spark, store, kind) == [("a", "A", "x")]


def test_edges_live_while_an_authority_holds_them(spark, tmp_path):
    store, kind = str(tmp_path / "s"), S.KINDS["edge"]
    S.create(spark, store, 4)
    schema = "op string, override boolean, name1 string, name2 string, type_id int, authority string, day string"
    drop = lambda *ops: spark.createDataFrame(ops, schema).withColumn("at", F.col("day").cast("timestamp")).drop("day")
    S.apply(spark, store, kind, drop(("set", None, "a", "b", 1, "x", "2024-01-01"), ("set", None, "a", "b", 1, "y", "2024-01-01"), ("set", None, "c", "b", 1, "x", "2024-01-01")))
    S.apply(spark, store, kind, drop(("kill", None, "a", "b", 1, None, "2024-01-02"), ("set", None, "a", "b", 1, "y", "2024-01-02")))  # all authorities, but y sets it again
    again = drop(("kill", True, "c", None, None, "x", "2024-01-03"))
    S.apply(spark, store, kind, again)
    v, _ = S.apply(spark, store, kind, again)
    assert v == 3
    got = {(r.name1, r.authority): (r.live, r.size) for r in S.read(spark, store, kind).collect()}
    assert got == {("a", "x"): (False, 2), ("a", "y"): (True, 1), ("c", "x"): (False, 2)}


def test_a_session_leaves_the_base_as_it_is(spark, tmp_path):
    g = graph.stored(graph.projected(spark, SF), str(tmp_path / "g"))
    before = files(str(tmp_path / "g"))
    s = Session(g, str(tmp_path / "delta"))
    roots = g.nodes.where("space_id = 1").select("node_id")
    reach = lambda x: T.expand(graph.oriented(x.edges.where("type_id = 1"), x.types), roots).count()
    n = reach(g)
    assert s.transient(spark.createDataFrame([(999, 1, 1), (999, 1, 1)], "name1 long, name2 long, type_id int"), "k", authority="me") == 1
    assert reach(s.graph()) == n + 1 and s.graph().history.where("authority = 'me'").count() == 1
    s.remove(spark.createDataFrame([(999, 1, 1)], "name1 long, name2 long, type_id int"))
    assert reach(s.graph()) == n == reach(g)
    s.exclude(roots)
    assert reach(s.graph()) == 0 and s.graph().nodes.where("space_id = 1").isEmpty()
    s.recall_roots()
    assert s.roots().count() == 0
    assert files(str(tmp_path / "g")) == before
    s.close()
    assert not (tmp_path / "delta").exists() and reach(s.graph()) == n


def test_a_changed_table_makes_a_new_graph(spark, tmp_path):
    """The stored graph goes by the tables' files, not by their path; forget() removes what was stored."""
    import shutil

    for name in graph._TABLES:
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    n = graph.from_tables(spark, str(tmp_path)).nodes.where("space_id = 6").count()
    (tmp_path / "orders.parquet").unlink()
    spark.read.parquet(f"{SF}/orders.parquet").limit(10).write.parquet(str(tmp_path / "orders.parquet"))
    assert n > 10 and graph.from_tables(spark, str(tmp_path)).nodes.where("space_id = 6").count() == 10
    folders = [f for k, f in graph._STORED.items() if k[1] == str(tmp_path)]
    assert graph.forget(spark, str(tmp_path)) == 2 and not any(os.path.exists(f.removeprefix("file:")) for f in folders)


def test_more_symmetric_types_than_literals(spark, monkeypatch):
    types = spark.createDataFrame([(k, f"r{k}", f"r{k}" if k % 2 else f"b{k}") for k in range(10)], "type_id int, forward string, backward string")
    edges = spark.createDataFrame([(k, 100 + k, k, True, 1) for k in range(10)] + [(5, 6, 99, True, 1)], "name1 long, name2 long, type_id int, live boolean, space_id int")
    few = sorted(map(tuple, graph.oriented(edges, types).collect()))
    monkeypatch.setattr(graph, "LITERALS", 3)
    assert sorted(map(tuple, graph.oriented(edges, types).select("mine", "other", "type_id", "dir", "live", "space_id").collect())) == sorted((m, o, t, d, live, s) for m, o, d, t, live, s in few)


def test_an_index_reads_only_what_is_asked(spark, tmp_path):
    from weftgraph.operators.word_index import WordIndex

    index = WordIndex(spark, str(tmp_path / "w"), buckets=16)
    texts = spark.createDataFrame([(k, "s", f"common word{k} red") for k in range(300)] + [(1, "s", "common common"), (None, "s", None)], "id long, source string, text string")
    assert index.load("9606", texts) == 1 and index.load(10090, texts.limit(5)) == 1
    asked = spark.createDataFrame([("WORD7",), ("NOSUCH",)], "word string")
    read = index.hits(asked, ["9606"]).inputFiles()
    buckets = {r.b for r in asked.select(index._bucket().alias("b")).collect()}
    assert read and all("taxon=9606" in f for f in read) and {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= buckets
    got = index.resolve(spark.createDataFrame([(1, "red word7 common"), (2, "nosuch"), (3, None)], "query_id long, text string"), ["9606"])
    assert [(r.query_id, r.id) for r in got.orderBy("query_id", F.desc("score")).collect()][:1] == [(1, 7)] and got.where("query_id = 1").count() == 1  # the others have blacklisted words alone
    assert index.load(9606, texts.limit(2)) == 2 and index.hits(asked, [9606]).join(asked, "word", "left_semi").count() == 0
    index.drop("9606", keep=1)
    assert index.taxa() == {"9606": 2, "10090": 1}
    assert index.hits(asked, ["none"]).count() == 0


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    from weftgraph.sources import writers as W

    folder = str(tmp_path / "t")
    W.write_table(spark.range(5), folder)
    boom = spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")))
    for mode in ("append", "drop"):
        with pytest.raises(Exception, match="boom"):
            W.write_table(boom, folder, mode)
    assert sorted(r.id for r in W.read_table(spark, folder).collect()) == [0, 1, 2, 3, 4] and W.table_folders(spark, folder)[0] == 1
    with pytest.raises(ValueError, match="has columns"):
        W.write_table(spark.range(3).withColumn("x", F.lit(1)), folder)
    with pytest.raises(ValueError, match="no mode"):
        W.write_table(spark.range(3), folder, "replace")


def test_dumps_with_quotes_and_brackets(spark, tmp_path):
    from weftgraph.sources import readers, writers

    texts = ["it's", "a,b);(c", "back\\slash\\n", "two\nlines", "", None, "''", "x" * 20_000 + "'y"]
    rows = spark.createDataFrame([(k, t, k * 1.5 - 2) for k, t in enumerate(texts)], "id long, title string, x double")
    writers.sql_dump_lines(rows, "page", 3).coalesce(1).write.option("lineSep", ";\n").text(str(tmp_path / "d"))
    other = "-- a comment;\nCREATE TABLE `page` (id int);\nINSERT INTO `links` VALUES (1,'page');\nINSERT INTO `page` (`id`,`title`,`x`) VALUES (90,'doubled ''quote''',NULL),(91,NULL,1e3), (92,'(',0);\n"
    (tmp_path / "d" / "more.sql").write_text(other)
    got = {r.id: (r.title, r.x) for r in readers.sql_dump(spark, str(tmp_path / "d"), "page", "id long, title string, x double").collect()}
    assert got == {k: (t, k * 1.5 - 2) for k, t in enumerate(texts)} | {90: ("doubled 'quote'", None), 91: (None, 1000.0), 92: ("(", 0.0)}
