"""Operators on hand-made tables: cases that the generated tables lack."""

import json
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import edges as E
from weftgraph.operators import intervals as I
from weftgraph.operators import lists as L
from weftgraph.operators import network as N
from weftgraph.operators import resolve as R
from weftgraph.operators import traverse as T
from weftgraph.operators.stretches import numbered
from weftgraph.plans.graph import oriented, read_as, with_reading
from weftgraph.plans.shared import met, temporary, written
from weftgraph.sources import readers, writers
from weftgraph.streaming import ingest as G


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edges(spark, *pairs, kind=1):
    return spark.createDataFrame([(a, b, kind, True, 1) for a, b in pairs], "name1 long, name2 long, type_id int, live boolean, space_id int")


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([(1, "is under", "is over"), (5, "is like", "is like"), (7, "cites", "is cited by"), (9, "meets", "meets")], "type_id int, forward string, backward string")


def test_types_come_from_the_graph(spark, types):
    """Types and symmetric types that no module names."""
    e = edges(spark, (1, 2), kind=7).union(edges(spark, (3, 4), kind=9)).union(edges(spark, (5, 6), kind=8))
    got = with_reading(oriented(e, types), types).select("mine", "other", "dir", "reading")
    assert rows(got) == sorted([(1, 2, 1, "cites"), (2, 1, -1, "is cited by"), (3, 4, 0, "meets"), (4, 3, 0, "meets"), (5, 6, 1, None), (6, 5, -1, None)], key=str)
    both = oriented(e, types)
    assert rows(both.where(read_as(types, "is cited by", "meets")).select("mine")) == [(2,), (3,), (4,)]
    assert rows(both.where(read_as(types, "#2#cites")).select("mine")) == [] and rows(both.where(read_as(types, "#1#cites")).select("mine")) == [(1,)]
    h = spark.createDataFrame([(4, 3, 9, "A", True, 1)], "name1 long, name2 long, type_id int, authority string, live boolean, size int")
    empty = spark.createDataFrame([], "node_id long, class_id int")
    g = SimpleNamespace(edges=e, types=types, history=h, meta=None, labels=empty, classes=None, taxa=None, nodes=None)
    assert rows(E.edge_query(g, keep_authority=["A"]).select("mine", "other")) == [(3, 4), (4, 3)]


def test_halts_by_type_and_ungrouped_nodes(spark, types):
    links = oriented(edges(spark, (1, 2), (1, 3), (1, 4), kind=7).union(edges(spark, (2, 5), kind=9)).union(edges(spark, (5, 6), kind=7)), types)
    seed = spark.createDataFrame([(1,)], "node_id long")
    assert {r.depth for r in T.expand(links, seed, 5, group_at=3).collect()} == {1}
    assert {r.depth for r in T.expand(links, seed, 5, group_at=3, ungrouped=seed).collect()} == {1, 2, 3}
    assert {r.other for r in T.expand(links, seed, 5, halt_types=[9]).collect()} == {2, 3, 4, 5}


def test_edges_among_the_seeds_are_kept_but_not_followed(spark, types):
    links = oriented(edges(spark, (1, 2), (2, 3), (3, 4)), types)
    two = spark.createDataFrame([(1,), (2,)], "node_id long")
    assert rows(T.expand(links, two, 1).select("mine", "other", "depth")) == [(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 4, 2)]


def test_numbers_and_runs_over_stretches(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(60), k) for k in range(500)]
    df = spark.createDataFrame(data, "g string, x int, k int").repartition(7)
    got = rows(numbered(df, ["g"], [F.col("x").desc()]).select("g", "x", "rank").distinct())
    want = {(g, x, 1 + sum(h == g and y > x for h, y, _ in data)) for g, x, _ in data}
    assert got == sorted(want, key=str)
    assert sorted(r.rank for r in numbered(df, [], [F.col("x").asc(), F.col("k").asc()], ties=False).collect()) == list(range(1, 501))
    spans = [("s", a, a + rng.randrange(1, 9)) for a in (rng.randrange(4000) for _ in range(300))]
    runs = []
    for _, a, b in sorted(spans):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
            runs[-1][2] += 1
        else:
            runs.append([a, b, 1])
    merged = I.merged(spark.createDataFrame(spans, "seq string, start int, end int").repartition(5), ["seq"])
    assert sorted((r.start, r.end, r.n) for r in merged.collect()) == sorted(map(tuple, runs))


def test_overlaps_of_very_unlike_lengths(spark):
    rng = random.Random(7)
    some = lambda n, c: [("q", k, a, a + rng.choice((0, 3, 300, 5_000, 900_000_000))) for k, a in enumerate(rng.randrange(1_000_000) for _ in range(n))]
    a, b = some(60, "a"), some(60, "b")
    got = I.overlapping(*(spark.createDataFrame(x, f"seq string, {c}_id int, {c}_start long, {c}_end long") for x, c in ((a, "a"), (b, "b"))), within=10)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted((i, j) for _, i, s, e in a for _, j, t, f in b if s - 10 <= f and e + 10 >= t)


def test_tails_against_single_terms():
    rng = random.Random(3)
    cases = [(rng.randrange(0, 12), rng.randrange(1, 60), rng.randrange(1, 80), 200, rng.random() < 0.5) for _ in range(200)] + [(3, 100, 50, 10**8, False), (90_000, 10**6, 10**6, 10**7, True)]
    got = R.tails(*(np.array(x) for x in zip(*cases, strict=True)))
    for (k, n, size, world, under), x in zip(cases, got, strict=True):
        if world > 200:
            assert -40_000 < x < 0
            continue
        terms = range(0, k + 1) if under else range(k, min(n, size) + 1)
        p = sum(math.comb(size, i) * math.comb(world - size, n - i) for i in terms if i <= size and i <= n) / math.comb(world, n)
        assert math.isclose(x, math.log10(p) if p else -999, abs_tol=1e-9)


def test_terms_too_rare_to_report_still_count_as_tests(spark):
    ids = [(f"t{k % 4}", k) for k in range(400)]
    terms = spark.createDataFrame(ids + [("same", k) for k in range(40)], "term string, id int")
    picked = spark.createDataFrame([(k,) for k in range(40)], "id int")
    all_terms = {r.term: r.log_p_all for r in R.enrichment(terms, picked).collect()}
    few = {r.term: r.log_p_all for r in R.enrichment(terms, picked, least=1e-20).collect()}
    assert "same" in all_terms and "same" not in few and all(few[t] == all_terms[t] for t in few)


def test_symmetric_edges_and_self_edges_are_read_once(spark, types):
    got = oriented(edges(spark, (1, 2), (3, 3), kind=5), types).select("mine", "other", "dir")
    assert rows(got) == [(1, 2, 0), (2, 1, 0), (3, 3, 0)]


def test_closure_of_a_cycle_ends(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 3), (4, None)], "child int, parent int")
    assert rows(T.closure(links)) == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2)]


def test_long_chain_takes_few_rounds(spark):
    links = spark.range(40).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    got = T.closure(links)
    assert got.count() == 40 * 41 // 2 and got.where("depth != ancestor - node").isEmpty()


def test_deep_hierarchies_and_far_nodes_are_whole(spark):
    links = spark.range(110).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    assert T.closure(links).count() == 110 * 111 // 2 and T.closure(links, 3).agg(F.max("depth")).first()[0] == 3
    seed = spark.createDataFrame([(0,)], "node_id long")
    far = T.distances(links.select(F.col("child").alias("mine"), F.col("parent").alias("other")), seed)
    assert far.count() == 111 and far.where("distance != node_id").isEmpty()


def test_no_recursion_walks_one_hop_and_hubs_stop(spark, types):
    links = oriented(edges(spark, (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 7), (8, 2)), types)
    seed = spark.createDataFrame([(8,)], "node_id long")
    assert rows(T.expand(links, seed).select("mine", "other", "depth")) == [(8, 2, 1)]
    far = T.expand(links, seed, recurse=5, group_at=5)
    assert (1, 6, 3, False) in rows(far.select("mine", "other", "depth", "grouped"))  # four new edges: the one to 2 is known
    hub = T.expand(links, spark.createDataFrame([(1,)], "node_id long"), recurse=5, group_at=5)
    assert {r.depth for r in hub.collect()} == {1} and all(r.grouped for r in hub.collect())


def test_expand_from_nothing(spark, types):
    links = oriented(edges(spark, (1, 2)), types)
    assert T.expand(links, spark.createDataFrame([], "node_id long"), recurse=2).isEmpty()


def test_paths_take_the_short_way_unless_slack(spark, types):
    links = oriented(edges(spark, (1, 2), (2, 3), (1, 4), (4, 5), (5, 3)), types)
    start, end = (spark.createDataFrame([(k,)], "node_id long") for k in (1, 3))
    assert [r.path for r in T.find_paths(links, start, end).collect()] == [[3, 2, 1]]
    both = T.find_paths(links, start, end, slack=1).collect()
    assert sorted(r.path for r in both) == [[3, 2, 1], [3, 5, 4, 1]]
    assert math.isclose(next(r.score for r in both if len(r.path) == 4), 0.95**3)


def test_components_and_pointers(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (2, 1), (3, 3), (9, 8)], "a long, b long")
    assert rows(T.components(links)) == [(1, 1), (2, 1), (4, 4), (5, 4), (8, 4), (9, 4)]
    pointers = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 5), (6, 7), (6, 8)], "source long, target long")
    assert rows(T.chased(pointers)) == [(1, 4), (2, 4), (3, 4), (6, 7)]


def test_hot_keys_are_met_where_their_rows_are(spark):
    """A key with half of a million rows, and rows without one: no task of the join gets more than the others."""
    n = 1_000_000
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(n, numPartitions=8).select(key.alias("k"), F.col("id").alias("v"))
    other = df.where("k IS NOT NULL").select("k").distinct().withColumn("w", F.col("k") + 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            out = met(df, other, "k", how)
            assert out.agg(F.count("*"), F.sum(F.col("w") - F.col("k"))).first() == (n if how == "left" else n - n // 10, n - n // 10)
            sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
            assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_temporary_tables_go_at_the_end(spark):
    outside = written(spark.range(3))
    with temporary(spark):
        inside = written(outside.where("id > 0"))
        with temporary(spark):
            inner = written(inside)
        assert inside.count() == 2
    paths = [df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for df in (outside,)]
    assert os.path.isdir(paths[0]) and outside.count() == 3
    for gone in (inside, inner):
        with pytest.raises(Exception, match="(?i)not exist|not found"):
            gone.collect()


def test_components_with_hubs(spark):
    """Two hubs, one the least and one the greatest of its cluster, beside a chain and random links."""
    rng = random.Random(1)
    pairs = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1400)] + [(k, k + 1) for k in range(3000, 3200)] + [(5000, 5001 + k) for k in range(900)] + [(6000 + k, 7000) for k in range(900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in T.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: find(x) for x in linked}


def test_pointers_are_chased_to_the_end(spark):
    chain = spark.range(1000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = T.chased(chain)
    assert got.count() == 1000 and got.where("target != 1000").isEmpty()
    ring = [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)] + [(2100 + k, 2101 + k) for k in range(20)] + [(2120, 2003), (2201, 2200), (2200, 2201)]
    got = T.chased(chain.unionByName(spark.createDataFrame(ring, "source long, target long")))
    want = [(2000 + k, 2000) for k in range(1, 7)] + [(2100 + k, 2000) for k in range(21)] + [(2201, 2200)]
    assert rows(got.where("source >= 2000")) == want and got.where("source < 1000 AND target = 1000").count() == 1000


def test_wildcards(spark):
    names = spark.createDataFrame([("A_B",), ("AxB",), ("a_b",), ("A_BC",), (None,)], "name string")
    assert rows(names.where(X.name_matches(F.col("name"), "a_b%"))) == [("A_B",), ("A_BC",), ("a_b",)]
    assert rows(names.where(X.name_matches(F.col("name"), "A?B", heeds_case=True))) == [("A_B",), ("AxB",)]
    for bad in ("%", "?", "_%", ""):
        with pytest.raises(ValueError):
            X.name_matches(F.col("name"), bad)
    assert X.token("#S#x") == ("S", 0, "x") and X.token("?abc") == (None, 1, "abc") and X.token("!?#S#y") == ("S", -1, "y") and X.token("??z") == (None, 0, "z")


def test_scalar_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    assert value(X.author(F.lit("Smith,J.A. Jr."))) == "SMITH JA"
    assert value(X.significant(F.lit(123456.0))) == 123000 and value(X.significant(F.lit(0.0012345))) == 0.00123 and value(X.significant(F.lit(0.0))) == 0
    assert [value(X.chromosome(F.lit(s))) for s in ("chr07", "homo_sapiens.chromosome.X.NCBI36", "mt")] == ["7", "X", "MT"]
    assert [value(X.accession_kind(F.lit(s))) for s in ("NM_0001.2", "gi|12", "AB12.3", "x")] == ["refseq", "gi", "versioned", "other"]
    assert str(value(X.any_date(F.lit("2001 Mar")))) == "2001-03-01" and value(X.any_date(F.lit("soon"))) is None
    assert value(X.components_of(F.lit("CC.CCO.[Na]"))) == ["[Na]", "CCO", "CC"]
    assert value(X.shortened_list(F.array(*map(F.lit, "abcd")), 2)) == "a, b +2"


def test_intervals_touch_and_do_not_repeat(spark):
    a = spark.createDataFrame([("s", 1, 0, 1000), ("s", 2, 2000, 2010)], "seq string, a_id int, a_start int, a_end int")
    b = spark.createDataFrame([("s", 7, 1000, 1000), ("s", 8, 1001, 1999), ("t", 9, 0, 5)], "seq string, b_id int, b_start int, b_end int")
    assert rows(I.overlapping(a, b, width=16).select("a_id", "b_id")) == [(1, 7)]
    near = I.nearest(a, b, within=5, width=16).select("a_id", "b_id", "distance")
    assert rows(near) == [(1, 7, 0), (2, 8, -1)]


def test_lift_on_both_strands(spark):
    maps = spark.createDataFrame([(1, "a", 10, 19, "b", 100, 129, 1), (2, "a", 10, 19, "c", 100, 109, -1)], "map_id int, seq1 string, start1 int, end1 int, seq2 string, start2 int, end2 int, strand int")
    points = spark.createDataFrame([(1, "a", 10), (2, "a", 12), (3, "a", 20)], "point_id int, seq string, pos int")
    assert rows(I.lifted(points, maps).select("point_id", "seq2", "pos2")) == [(1, "b", 100.0), (1, "c", 109.0), (2, "b", 106.0), (2, "c", 107.0)]


def test_contiguous_runs_cross_blocks(spark):
    edge = 1 << 20
    ids = spark.createDataFrame([(x,) for x in (1, 2, 5, edge - 1, edge, edge + 1, 3 * edge)], "x long")
    assert sorted(tuple(r) for r in I.contiguous(ids, "x").collect()) == [(1, 2), (5, 5), (edge - 1, edge + 1), (3 * edge, 3 * edge)]


def test_hypergeometric_tails():
    def brute(k, n, size, world, under):
        chance = sum(math.comb(size, i) * math.comb(world - size, n - i) for i in (range(k + 1) if under else range(k, min(size, n) + 1))) / math.comb(world, n)
        return math.log10(chance)

    for case in ((0, 5, 4, 20, False), (4, 5, 4, 20, False), (1, 5, 10, 20, True), (3, 5, 4, 20, False), (0, 5, 4, 20, True)):
        assert math.isclose(R.tails(*(np.array([x]) for x in case))[0], brute(*case), abs_tol=1e-9)
    assert R.tails(*(np.array([x]) for x in (5, 5, 4, 20, False)))[0] == -999


def test_reciprocal_best_needs_closed_ties(spark):
    pairs = spark.createDataFrame([("a", "x", 9, 1, 1), ("b", "x", 8, 1, 1), ("b", "y", 7, 1, 1), ("c", "z", 5, 1, 1), ("d", "z", 5, 1, 1), ("d", "w", 5, 1, 1), ("e", "w", 6, 1, 1)], "a string, b string, identity int, matched int, similar int")
    assert rows(R.reciprocal_best(pairs)) == [("a", "x", 1, 1), ("e", "w", 1, 1)]


def test_chain_scores(spark):
    first = spark.createDataFrame([("p", "q", 0.5), ("p", "r", 0.9), ("p", "u", None)], "term_in string, term_out string, score double")
    second = spark.createDataFrame([("q", "z", 0.9), ("r", "z", 0.4), ("u", "v", 1.0)], "term_in string, term_out string, score double")
    assert rows(L.chain([first, second]).select("input", "output", F.round("score", 6))) == [("p", "v", None), ("p", "z", 0.45)]
    assert rows(L.chain([first, second], "least").select("input", "output", "score")) == [("p", "v", None), ("p", "z", 0.5)]
    scored = spark.createDataFrame([("a", None), ("a", 0.2), ("b", None)], "k string, score double")
    assert rows(L.keep_best(scored, ["k"])) == [("a", 0.2), ("b", None)]
    assert L.floor_score(scored, 0.5).count() == 2 and L.floor_score(scored, 0.5, keep_null=False).isEmpty()


def test_partial_edges_and_missing_ones(spark):
    e = edges(spark, (1, 2), (1, 3), (4, 2))
    assert E.partly_specified(e, name1=F.col("name1") == 1, type_id=1, space_id=None).count() == 2
    wanted = spark.createDataFrame([(1, 2, 1), (9, 9, 1), (9, 9, 1)], "name1 long, name2 long, type_id int")
    added = E.add_missing(wanted, e, ["name1", "name2", "type_id"], live=F.lit(False), space_id=F.lit(1))
    assert added.count() == 4 and added.where("NOT live").select("name1").first().name1 == 9


def test_kill_and_set_in_one_batch_leaves_the_edge_live(spark):
    ops = spark.createDataFrame([(1, 1, "set", "a", "b", 1, "u", "2024-01-01"), (2, 2, "kill", "a", "b", 1, "u", "2024-01-02"), (2, 3, "set", "a", "b", 1, "u", "2024-01-02"), (3, 4, "kill", "a", "b", 1, "u", "2024-01-03"), (3, 5, "set", "a", "b", 1, "v", "2024-01-03")], "batch long, seq long, op string, name1 string, name2 string, type_id int, authority string, at string").withColumn("at", F.col("at").cast("timestamp"))
    history = G.folded(ops)
    assert rows(history.select("authority", "live", "size")) == [("u", False, 2), ("v", True, 1)]
    assert rows(G.edge_states(history).select("live", "authorities")) == [(True, 1)]


def test_kill_with_wildcards_and_tags(spark):
    t = spark.createDataFrame([(1, 2, 3), (1, 5, 3), (4, 2, 9)], "name1 int, name2 int, type_id int")
    killed = spark.createDataFrame([(1, None, 3), (4, 2, 1)], "name1 int, name2 int, type_id int")
    assert rows(G.without(t, killed, ["name1", "name2", "type_id"])) == [(4, 2, 9)]
    meta = spark.createDataFrame([("a", "b", 1, "X", None, 1.0), ("a", "b", 1, "Y", "t", None), ("c", "d", 1, "X", None, 2.0)], "name1 string, name2 string, type_id int, tag string, text_value string, numeric_value double")
    changes = spark.createDataFrame([("a", "b", 1, "X", "12.5"), ("a", "b", 1, "Y", None), ("c", "d", 1, "%", None)], "name1 string, name2 string, type_id int, tag string, value string")
    assert rows(G.with_tags(meta, changes)) == [("a", "b", 1, "X", None, 12.5)]


def test_streamed_files_give_the_folded_state(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    ops = [{"batch": 0, "seq": k, "op": o, "name1": "a", "name2": "b", "type_id": 1, "authority": "u", "at": f"2024-01-0{k + 1}T00:00:00Z"} for k, o in enumerate(("set", "kill", "set"))]
    for k, op in enumerate(ops):
        (source / f"{k}.json").write_text(json.dumps(op))
        query = G.ingest(spark, str(source), store, str(tmp_path / "cp"))
        query.awaitTermination()
        assert query.exception() is None
    assert G.current(spark, store) == 3
    assert rows(G.read_version(spark, store).select("live", "size")) == [(True, 3)]
    assert rows(G.read_version(spark, store, 2).select("live", "size")) == [(False, 2)]


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    tab = readers.tab_table(spark, put("g.tab", "#c\n9606\t1\t-\n10090\t2\tx\n"), ["tax_id", "id", "name"], ["9606"])
    assert rows(tab) == [("9606", "1", None)]
    dump = readers.taxdump(spark, put("names.dmp", "1\t|\troot\t|\t\t|\n2\t|\tBacteria\t|\tu\t|\n"), ["tax_id", "name", "unique"])
    assert rows(dump) == [("1", "root", None), ("2", "Bacteria", "u")]
    records = readers.tagged_records(spark, put("u.data", "ID  Hs.1\nGENE  A\nEXPRESS  x\nEXPRESS  y\n//\nID  Hs.2\nGENE  B\n//\n"))
    assert ("Hs.1", "EXPRESS", 2, "y") in rows(records) and ("Hs.2", "GENE", 1, "B") in rows(records)
    assert rows(readers.fasta(spark, put("x.fa", ">a one two\nacg\nt\n>b\nGG\n"))) == [("a", "one two", "ACGT", 4), ("b", "", "GG", 2)]
    sdf = readers.structure_records(spark, put("x.sdf", "m1\nfoo\n> <ID>\nX1\n\n> <NAME>\nwater\n\n$$$$\nm2\n> <ID>\nX2\n\n$$$$\n"))
    assert rows(sdf) == [("m1", "ID", "X1"), ("m1", "NAME", "water"), ("m2", "ID", "X2")]
    terms, links = readers.ontology(spark, put("x.obo", "format-version: 1.2\n\n[Term]\nid: T:1\nname: top\nnamespace: n\n\n[Term]\nid: T:2\nname: low\nis_a: T:1 ! top\nrelationship: part_of T:3 ! x\nis_obsolete: true\n"))
    assert rows(terms) == [("T:1", "top", "n", False), ("T:2", "low", None, True)]
    assert rows(links) == [("T:2", "T:1", "is_a"), ("T:2", "T:3", "part_of")]
    xml = readers.xml_rows(spark, put("x.xml", "<all><e><id>1</id><n>a</n><n>b</n></e></all>"), "e", "id long, n array<string>")
    assert rows(xml) == [(1, ["a", "b"])]
    lists = readers.ranked_lists(spark, put("l.txt", "# LIST one\n# SIZE = 3\n'x'\t1\ny\t2\n# LIST two\nz\t1\n"))
    assert rows(lists.select("list", "rank", "id", "metadata")) == [("one", 1, "x", {"SIZE": "3"}), ("one", 2, "y", {"SIZE": "3"}), ("two", 1, "z", None)]
    assert rows(readers.genbank(spark, put("g.gb", "LOCUS       AB1  12 bp\nDEFINITION  some\n            thing.\nACCESSION   AB1\nORIGIN\n        1 acgt ac\n//\n"))) == [("AB1", "some thing.", "ACGTAC")]
    assert rows(readers.id_list(spark, "a, b;c a")) == [("a",), ("b",), ("c",)]
    for v in (1, 2):
        put(f"WP{v}_v{v}.csv", f"r{v}")
        put(f"WP9_v{v}.csv", f"n{v}")
    newest = readers.newest_files(spark.read.text(str(tmp_path / "WP*.csv")), r"^(WP\d+)_", r"_v(\d+)\.")
    assert rows(newest.select("value")) == [("n2",), ("r1",), ("r2",)]


def test_writers(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2, 0.5), (3, 1, 2.0)], "i int, j int, value double")
    head, lines = writers.matrix_market(cells)
    assert head.endswith("\n3 2 2") and rows(lines) == [("1 2 0.5",), ("3 1 2.0",)]
    assert rows(writers.fasta(spark.createDataFrame([("a", "ACGTA")], "name string, sequence string"), 2)) == [(">a\nAC\nGT\nA",)]
    e = spark.createDataFrame([("a<", "r", "b")], "name1 string, reading string, name2 string")
    assert rows(writers.xgmml(e)) == [('<edge source="a&lt;" target="b" label="r"/>',)]
    writers.write_lines(writers.sif(e), str(tmp_path / "sif"))
    assert rows(spark.read.text(str(tmp_path / "sif"))) == [("a<\tr\tb",)]


def test_bridged_blocks_are_joined_with_their_gaps(spark):
    kind = "id string, seq string, start int, end int, seq2 string, start2 int, end2 int, strand int"
    a = spark.createDataFrame([("A", "q", 1, 10, "x", 101, 110, 1), ("A", "q", 14, 20, "x", 111, 117, 1), ("A", "q", 60, 69, "x", 300, 309, 1)], kind)
    b = spark.createDataFrame([("B", "q", 1, 100, "y", 1, 300, -1)], kind)
    got = I.bridged(a, b, merge=20).orderBy("s1").collect()
    assert [(r.s1, r.e1, r.n, r.shared, r.gaps, r.strand) for r in got] == [(101, 117, 2, 17, 3, -1), (300, 309, 1, 10, 0, -1)]
    assert [(r.s2, r.e2) for r in got] == [(300 - 19 * 3, 300), (300 - 68 * 3, 300 - 59 * 3)] and math.isclose(got[0].coverage, 17 / 27)


def test_nearest_by_blocks_and_all(spark):
    a = spark.createDataFrame([("q", "A", 1, 10), ("q", "A", 50, 60)], "seq string, a_id string, a_start int, a_end int")
    b = spark.createDataFrame([("q", "in", 20, 22), ("q", "left", -20, -6), ("q", "on", 55, 70), ("q", "right", 65, 66)], "seq string, b_id string, b_start int, b_end int")
    assert rows(I.nearest_blocks(a, b, 30)) == [("A", "in", 10), ("A", "left", -7), ("A", "on", 0), ("A", "right", 5)]
    assert I.nearest(a, b, 30, keep_all=True).count() == 5


def test_list_helpers(spark):
    df = spark.createDataFrame([("a", 5.0, "IEA"), ("b", None, "TAS"), ("c", 1.0, None)], "name string, score double, evidence string")
    assert rows(L.by_evidence(df, "!IEA").select("name")) == [("b",)] and rows(L.by_evidence(df, "IEA", "TAS", "!TAS").select("name")) == [("a",)]
    for text, want in (("score > 2", "a"), ("!score > 2", "c"), ("score defined", "ac"), ("!score defined", "b"), ("name = b", "b"), ("score <= 1e0", "c")):
        assert "".join(sorted(r.name for r in df.where(L.predicate(text)).collect())) == want
    with pytest.raises(ValueError):
        L.predicate("score ~ 2")
    rules = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D"), ("D", "C"), ("C", "A")], "space_in string, space_out string")
    assert L.rule_path(rules, "A", "C") == ["A", "B", "C"] and L.rule_path(rules, "C", "X") == [] and L.rule_path(rules, "B", "D") == ["B", "C", "A", "D"]


def test_traversal_is_aborted_and_hubs_are_split(spark, types):
    links = oriented(edges(spark, (1, 2), (1, 3), (2, 4), (3, 5), (3, 6), (3, 7), (5, 8)), types)
    root = spark.createDataFrame([(1,)], "node_id long")
    mark = lambda *x: spark.createDataFrame(list(x), "node_id long, action string")
    nodes = lambda **o: [r.node for r in N.traversed(links, root, **o).orderBy("place").collect()]
    assert nodes() == [1, 2, 3, 4, 5, 6, 7, 8] and nodes(split_at=3) == [1, 2, 3, 4] and nodes(most_depth=1) == [1, 2, 3]
    assert nodes(actions=mark((3, "abort"))) == [1, 2, 3] and nodes(actions=mark((3, "skip"), (2, "hide"))) == [1, 4]


def test_orders_of_a_traversal(spark):
    """Depth first and by rank, on a tree with two roots; ranked against a queue that is served one at a time."""
    rng = random.Random(7)
    parent = {k: rng.randrange(max(0, k - 12), k) for k in range(2, 120)} | {1: None, 0: None}
    kind = {k: rng.choice([3, 5, 9]) for k in parent}
    links = spark.createDataFrame([(p, k, kind[k], 1) for k, p in parent.items() if p is not None] + [(k, p, kind[k], -1) for k, p in parent.items() if p is not None], "mine long, other long, type_id int, dir int")
    roots = spark.createDataFrame([(0,), (1,)], "node_id long")
    kids = {k: sorted(x for x, p in parent.items() if p == k) for k in parent}
    first, stack = [], [1, 0]
    while stack:
        first.append(node := stack.pop())
        stack += reversed(kids[node])
    assert [r.node for r in N.traversed(links, roots, most_depth=200, order="immediate").orderBy("place").collect()] == first
    score, depth = {3: 1.0, 5: 0.7, 9: 0.7}, {0: 0, 1: 0}
    for k in range(2, 120):
        depth[k] = depth[parent[k]] + 1
    queue, taken = [(-1.0, 0, 0), (-1.0, 0, 1)], []
    while queue:
        queue.sort()
        _, _, node = queue.pop(0)
        taken.append(node)
        queue += [(-score[kind[k]], depth[k], k) for k in kids[node]]
    by = F.when(F.col("type_id") == 3, 1.0).otherwise(0.7)
    assert [r.node for r in N.traversed(links, roots, most_depth=200, order="ranked", score=by).orderBy("place").collect()] == taken
    assert N.traversed(links, roots.limit(0), order="immediate").count() == 0
    with pytest.raises(ValueError, match="no order"):
        N.traversed(links, roots, order="random")


def test_edges_are_listed_once_from_the_end_that_comes_first(spark, types):
    links = oriented(edges(spark, (1, 2), (2, 3), (1, 3), (3, 3)), types)
    placed = N.traversed(links, spark.createDataFrame([(1,)], "node_id long"))
    assert [(r.place, r.mine, r.other) for r in N.listed_edges(links, placed).orderBy("place").collect()] == [(1, 1, 2), (2, 1, 3), (3, 2, 3), (4, 3, 3)]
    assert rows(N.listed_edges(links, placed, linear=True).select("mine", "other")) == [(1, 2), (1, 3)]


def test_nearest_against_all_pairs(spark):
    """Dense and empty stretches, ties on either side, overlaps: the neighbours that all pairs give."""
    rng = random.Random(11)
    make = lambda n, wide: [(f"s{rng.randrange(2)}", k, (at := rng.randrange(400)), at + rng.randrange(wide)) for k in range(n)]
    a, b = make(60, 6), make(80, 4) + [("s0", 500 + k, 1000, 1004) for k in range(30)]
    a += [("s0", 900, 1010, 1012), ("s0", 901, 990, 995), ("s9", 902, 1, 2), ("s0", 903, 5, 4)]
    da, db = spark.createDataFrame(a, "seq string, a_id long, a_start long, a_end long"), spark.createDataFrame(b, "seq string, b_id long, b_start long, b_end long")
    for flank in (False, True):
        want = set()
        for s, i, lo, hi in a:
            near = [(j, bh - lo if bh < lo else bl - hi if bl > hi else 0) for t, j, bl, bh in b if t == s and lo <= hi]
            near = [(j, d) for j, d in near if abs(d) <= 12]
            for group in [[x for x in near if (x[1] > 0) - (x[1] < 0) == side] for side in (-1, 0, 1)] if flank else [near]:
                want |= {(i, j, d) for j, d in group if abs(d) == min(abs(x) for _, x in group)}
        got = I.nearest(da, db, 12, flank=flank)
        assert {(r.a_id, r.b_id, r.distance) for r in got.collect()} == want and got.count() == len(want)


def test_ways_of_rules_by_what_they_can_score(spark):
    r = [("A", "B", 0.9), ("B", "C", 0.9), ("A", "C", 0.5), ("C", "D", 1.0), ("B", "D", 0.2), ("D", "A", 1.0), ("A", "A", 1.0), ("A", "E", None)]
    rules = spark.createDataFrame([(a, b, f"{a}1".lower(), f"{b}1".lower(), s) for a, b, s in r] + [("A", "C", "a1", "c1", 0.1)], "space_in string, space_out string, term_in string, term_out string, score double")
    assert L.best_ways(rules, "A", "D") == [["A", "B", "C", "D"], ["A", "C", "D"], ["A", "B", "D"]]
    assert L.best_ways(rules, "A", "D", k=1) == [["A", "B", "C", "D"]] and L.best_ways(rules, "D", "D") == [] and L.best_ways(rules, "E", "A") == []
    terms = spark.createDataFrame([("a1",), ("zz",)], "term string")
    (one,) = L.converted_best(terms, rules, "A", "D").collect()
    assert (one.input, one.output, round(one.score, 9), one.way) == ("a1", "d1", 0.81, ["A", "B", "C", "D"])
    assert L.converted_best(terms, rules, "E", "A").count() == 0


def test_clusters_grow_from_the_nearest_seed(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(k + 1, k) for k in range(10)], "mine long, other long")
    seeds = spark.createDataFrame([(0,), (6,)], "node_id long")
    got = {r.node: (r.seed, r.distance) for r in T.seeded(links, seeds).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (6, 2), 5: (6, 1), 6: (6, 0), 7: (6, 1), 8: (6, 2), 9: (6, 3), 10: (6, 4)}
    assert T.seeded(links, seeds, most=1).count() == 5
    assert T.seeded(links, seeds, through=links.where("other != 3").select(F.col("other").alias("node_id"))).where("node = 3").isEmpty()
