"""What the findings of round 3 were about, each by a small case that failed before."""

import os
import random

from oracle import compare

from weftgraph.llm import hidden_markov, jaccard_join
from weftgraph.operators import intervals as I
from weftgraph.operators import network as N
from weftgraph.operators import traverse as T
from weftgraph.plans import format_queries, graph, list_queries, registry, report_queries  # noqa: F401  they register their queries
from weftgraph.plans.shared import shared_folder

SF = "/root/testdata/sf0.001"


def test_a_report_with_columns_that_differ_by_case_can_be_written(spark, tmp_path):
    before = spark.conf.get("spark.sql.caseSensitive")
    got = registry.QUERIES["m12_pivot_report"](spark, SF)
    got.write.parquet(str(tmp_path / "report"))
    read = got.sparkSession.read.parquet(str(tmp_path / "report"))
    assert {"N", "n"} < set(read.columns) and spark.conf.get("spark.sql.caseSensitive") == before
    assert compare(read, registry.SQL["m12_pivot_report"], SF) == ""


def test_newest_files_of_many_suppliers_are_few(spark, tmp_path):
    spark.range(1, 301).selectExpr("id AS s_suppkey", "'S' || id AS s_name", "CAST(id % 2 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = registry.QUERIES["l13_newest"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("0", 300, "S300"), ("1", 299, "S299")]
    (made,) = (f for f in set(os.listdir(folder)) - before if f.startswith("newest-"))
    assert len([f for f in os.listdir(f"{folder}/{made}") if not f.startswith(("_", "."))]) == 2


def _recorded(monkeypatch) -> list[int]:
    sizes, plain = [], T.written

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(T, "written", counted)
    return sizes


def test_walks_through_a_hub_take_no_steps_away_from_the_start(spark, monkeypatch):
    """1 is the start, 2 a hub below it with 200 leaves: 200 walks of two steps, not 200 times 200 on the way."""
    down = spark.range(100, 300).selectExpr("id AS mine", "2L AS other").union(spark.range(1).selectExpr("2L", "1L"))
    links = down.union(down.select("other", "mine")).selectExpr("mine", "other", "1 AS type_id", "1 AS dir")
    sizes = _recorded(monkeypatch)
    found = T.find_paths(links, spark.range(1, 2).selectExpr("id AS node_id"), spark.range(100, 300).selectExpr("id AS node_id"), slack=1)
    assert sorted(r.path for r in found.collect()) == [[k, 2, 1] for k in range(100, 300)]
    assert sizes and 201 in sizes and max(sizes) <= 402  # of the 402 links the 201 towards the start are steps


def test_common_parents_take_no_window_over_pairs(spark):
    above = spark.createDataFrame([(1, 9, 2), (1, 5, 1), (2, 9, 2), (2, 5, 1), (3, 9, 1), (4, 8, 1)], "node long, ancestor long, depth int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 1), (1, 1)], "a long, b long")
    got = T.common_parents(above, pairs)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 0), (1, 2, 5, 2), (1, 3, 9, 3), (5, 1, 5, 1)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_closure_finds_each_pair_once(spark, monkeypatch):
    sizes = _recorded(monkeypatch)
    chain = [(k, k + 1) for k in range(20)] + [(0, 7), (20, 3)]  # a short cut and a circle
    links = spark.createDataFrame(chain, "child long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in T.closure(links).collect()}
    want = {}
    for start in range(21):
        level, depth, seen = {start}, 0, {start}
        while level:
            level, depth = {b for a, b in chain if a in level} - seen, depth + 1
            seen |= level
            want |= {(start, b): depth for b in level}
    assert got == want and sum(sizes) == len(want)


def test_a_query_computes_the_parts_of_the_graph_that_it_asks_for(spark):
    graph.forget(spark, SF)
    g = graph.from_tables(spark, SF)
    plan = g.edges.where("type_id IN (1, 2)")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" in plan
    made = [f for k, f in graph._STORED.items() if k[1] == SF]
    assert len(made) == 1 and not os.path.exists(made[0].removeprefix("file:"))
    kept = graph.from_tables(spark, SF, keep=True)
    assert os.path.exists(made[0].removeprefix("file:")) and kept.edges.count() == g.edges.count()
    assert graph.forget(spark, SF) == 1


def test_lines_are_written_in_as_many_files_as_tasks(spark):
    path = format_queries._written(spark, spark.range(0, 100, 1, 5).selectExpr("CAST(id AS STRING) AS value"))
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) == 5


def test_a_traversal_takes_few_jobs_for_each_level(spark):
    """A tree of ten levels, each number below its half: about 20 jobs a level before."""
    links = spark.range(2, 1024).selectExpr("id div 2 AS mine", "id AS other", "IF(id % 3 = 0, 7, 3) AS type_id", "1 AS dir")
    context = spark.sparkContext
    for order in ("immediate", "ranked"):
        context.setJobGroup(f"walk-{order}", "")
        got = [r.node for r in N.traversed(links, spark.range(1, 2).toDF("node_id"), most_depth=64, order=order).orderBy("place").collect()]
        jobs = len(context.statusTracker().getJobIdsForGroup(f"walk-{order}"))
        assert sorted(got) == list(range(1, 1024)) and got[:3] == ([1, 2, 4] if order == "immediate" else [1, 2, 3])
        assert jobs <= 100
    context._jsc.clearJobGroup()


def test_counts_of_nearest_take_no_pairs(spark):
    """As many as nearest() gives, on crowded and empty sequences and with ids of several rows, without a join of both sides."""
    a = spark.range(300).selectExpr("IF(id % 50 = 0, NULL, id % 4) AS seq", "IF(id > 280, NULL, id div 2 * 2) AS a_id", "CAST(id * 37 % 900 AS INT) AS a_start", "CAST(id * 37 % 900 + id % 9 - 1 AS INT) AS a_end")
    b = spark.range(200).selectExpr("id % 3 AS seq", "id AS b_id", "CAST(id * 91 % 950 AS INT) AS b_start", "CAST(id * 91 % 950 + id % 7 AS INT) AS b_end")
    for within in (0, 3, 2000):
        got = I.nearest_counts(a, b, within)
        want = I.nearest(a, b, within).groupBy("seq", "a_id", "distance").count()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count() > 0
    assert "b_id" not in I.nearest_counts(a, b, 20)._jdf.queryExecution().optimizedPlan().toString()
    plan = registry.QUERIES["j12_nearest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan


def test_training_takes_few_passes_over_every_text(spark, monkeypatch):
    """Eight passes before, for a score a token of -1.33965."""
    rng = random.Random(4)
    texts = []
    for k in range(400):  # runs of words of four kinds that share their commonest words
        w = []
        while len(w) < 60 + k % 90:
            kind = rng.randrange(4)
            w += [f"{'abcd'[kind]}{rng.randrange(12)}" if rng.random() < 0.6 else f"x{rng.randrange(6)}" for _ in range(rng.randrange(8, 30))]
        texts.append((k, " ".join(w)))
    seen, plain = [], hidden_markov._pass

    def counted(coded, model, shape):
        seen.append(coded.where("NOT held_out").count())
        return plain(coded, model, shape)

    monkeypatch.setattr(hidden_markov, "_pass", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8, "doc_id")
    got = hidden_markov.score(docs, hidden_markov.Shape(states=4, own=64, shared=8, known=64)).collect()
    train = [r for r in got if not r.held_out]
    assert len(got) == 400 and sum(seen) % len(train) == 0 and sum(seen) <= 6 * len(train)
    assert sum(r.score for r in train) / sum(r.n_tokens for r in train) > -1.3397


def test_near_copies_are_found_by_few_jobs(spark, tmp_path):
    """Each stage of each plan, with its scans and broadcasts, takes memory of the driver: 103 jobs before."""
    rng = random.Random(7)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(60)]
    texts = [(k, x) for k, x in enumerate(plain)] + [(100 + k, x + " end") for k, x in enumerate(plain[:20])] + [(200 + k, plain[0]) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    context = spark.sparkContext
    context.setJobGroup("near-copies", "")
    jaccard_join.one_of_each(docs).write.parquet(str(tmp_path / "kept"))
    jobs = len(context.statusTracker().getJobIdsForGroup("near-copies"))
    context._jsc.clearJobGroup()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == list(range(60))
    assert jobs <= 95
