"""Edits of a network, traversal as an ordered list (by level, depth first, or by rank), and status of deprecated names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.stretches import numbered
from weftgraph.operators.traverse import chased
from weftgraph.plans.shared import written


def without_edges(edges: DataFrame, gone: DataFrame, key: Sequence[str] = ("name1", "name2", "type_id")) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): the edges that are not in gone, and the nodes (node_id) that still have one."""
    kept = edges.join(gone.select(*key).distinct(), list(key), "left_anti")
    return kept, kept.select(F.col("name1").alias("node_id")).union(kept.select("name2")).distinct()


def without_tagged(edges: DataFrame, meta: DataFrame, tag: str, value: Column) -> DataFrame:
    """Edges but for those with metadata under this tag whose value (of text_value, numeric_value) satisfies the condition."""
    hit = meta.where((F.col("tag") == tag.upper()) & F.coalesce(value, F.lit(False)))
    return edges.join(hit.select("name1", "name2", "type_id").distinct(), ["name1", "name2", "type_id"], "left_anti")


def proxied(edges: DataFrame, by: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with each node of by (node_id, proxy) replaced by its proxy with the shortest name, then the first; edges between both go."""
    order = Window.partitionBy("node_id").orderBy(F.length("name"), "name", "proxy")
    one = by.join(names.select(F.col("node_id").alias("proxy"), "name"), "proxy").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("node_id", "proxy")
    for c in ("name1", "name2"):
        at = one.select(F.col("node_id").alias(c), F.col("proxy").alias(f"_{c}"))
        edges = edges.join(at, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return edges.where("name1 != name2").distinct()


def _entered(hop: DataFrame, ranked: bool) -> DataFrame:
    """node, parent, worse (the score, negative) and the parent's way, if it has one: one way into each node, from the least parent, with ranks from the least of those with the best score."""
    kept = [c for c in hop.columns if c == "_way"]
    way = F.min(F.struct(*(("worse", "mine") if ranked else ("mine", "worse")), *kept)).alias("_w")
    return hop.withColumn("worse", -F.col("score")).groupBy("node").agg(way).select("node", F.col("_w.mine").alias("parent"), F.col("_w.worse").alias("worse"), *[F.col(f"_w.{c}").alias(c) for c in kept])


def traversed(links: DataFrame, roots: DataFrame, actions: DataFrame | None = None, most_depth: int = 10, split_at: int | None = None, order: str = "level", score: Column | None = None) -> DataFrame:
    """place, node, parent, depth: the nodes that oriented links reach from the roots (node_id), each once.

    actions (node_id, action): `skip` leaves a node out and does not follow it, `hide` leaves it out but
    follows it, `keep` lists it but does not follow it, `abort` lists it and ends the traversal with
    its level. A node with `split_at` or more new links is listed but not followed. A node hangs from
    one parent on the level above: with ranks the one whose link has the best score, then the least.

    order: `level` by level, parent's place and id; `immediate` takes all below a node before its next
    sibling, which come by id; `ranked` always takes, of all nodes whose parent is taken, the one with
    the best score (of its link, a Column over type_id and dir; 1 unless given), then the least depth,
    then the least id.

    Rounds are as many as levels, each one write of the level. But for order by level a node carries its
    way from the root (with ranks what is worse than all after it), of at most most_depth steps, in
    whose order all nodes are numbered by stretches; so no task holds a subtree or all siblings.
    """
    if order not in ("level", "immediate", "ranked"):
        raise ValueError(f"no order named {order}")
    ranked, plain = order == "ranked", order == "level"
    scored = links.select("mine", F.col("other").alias("node"), (F.lit(1.0) if score is None else score).cast("double").alias("score"))
    marks = None if actions is None else actions.select(F.col("node_id").alias("node"), "action")

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("action", F.lit(None).cast("string")) if marks is None else rows.join(marks, "node", "left")

    def more(level: DataFrame) -> tuple[bool, bool]:
        """Whether the level has nodes, and whether it is the last."""
        n, ends = level.agg(F.count("*"), F.count_if(F.col("action") == "abort")).first()
        return n > 0, ends > 0

    top = roots.select(F.col("node_id").cast("long").alias("node")).distinct().select("node", F.lit(None).cast("long").alias("parent"), F.lit(-1.0).alias("worse"), F.lit(0).alias("depth"))
    own = F.array(F.struct("worse", "depth", "node")) if ranked else F.array("node")
    ways = [] if plain else ["way"]
    level = written(marked(top if plain else top.withColumn("way", own)))
    found, last = level, more(level)[1]
    for depth in range(1, most_depth + 1):
        if last:
            break
        open_ = level.where("action IS NULL OR action = 'hide'").select(F.col("node").alias("mine"), *[F.col(c).alias("_way") for c in ways])
        hop = scored.join(open_, "mine").join(found.select("node"), "node", "left_anti")
        if split_at is not None:
            new = Window.partitionBy("mine")
            hop = hop.groupBy("mine", "node").agg(F.max("score").alias("score"), *[F.first("_way").alias("_way") for _ in ways])
            hop = hop.withColumn("_n", F.count("*").over(new)).where(F.col("_n") < split_at).drop("_n")
        entered = _entered(hop, ranked).withColumn("depth", F.lit(depth))
        if ranked:  # of the way from the root only what is worse than all after it counts
            entered = entered.withColumn("way", F.concat(F.filter("_way", lambda w: w > F.struct("worse", "depth", "node")), own))
        elif not plain:
            entered = entered.withColumn("way", F.concat("_way", own))
        level = written(marked(entered).select(*found.columns))
        some, last = more(level)
        if not some:
            break
        found = found.unionByName(level)
    shown = "action IS NULL OR action NOT IN ('skip', 'hide')"
    by = [F.col("depth").asc(), F.col("parent").asc_nulls_first(), F.col("node").asc()] if plain else [F.col("way").asc()]
    return numbered(found.where(shown), [], by, "place", ties=False).select("place", "node", "parent", "depth")


def listed_edges(links: DataFrame, placed: DataFrame, linear: bool = False) -> DataFrame:
    """place, mine, other, type_id, dir: the links among traversed() nodes, each once, from the end that is taken first; in the order of its place, type and the other's place.

    linear: only those that lead from a node's parent to the node, so that there are no circles.
    """
    near = placed.select(F.col("node").alias("mine"), F.col("place").alias("_a"))
    far = placed.select(F.col("node").alias("other"), F.col("place").alias("_b"), F.col("parent").alias("_parent"))
    both = links.select("mine", "other", "type_id", "dir").join(near, "mine").join(far, "other").where("_a < _b OR (_a = _b AND dir >= 0)")
    if linear:
        both = both.where("_parent = mine")
    rows = both.select("mine", "other", "type_id", "dir", "_a", "_b").distinct()
    order = [F.col(c).asc() for c in ("_a", "type_id", "dir", "_b")]
    return numbered(rows, [], order, "place", ties=False).select("place", "mine", "other", "type_id", "dir")


def status(terms: DataFrame, pointers: DataFrame) -> DataFrame:
    """term, status, usable: live terms are usable themselves, deprecated ones (live = false) as the live term their pointers end at.

    terms: term, live; pointers: source, target. A deprecated term that leads to no live one, and a term
    that terms lacks, has no usable one.
    """
    end = chased(pointers).select(F.col("source").alias("term"), "target").join(terms.select(F.col("term").alias("target"), F.col("live").alias("_good")), "target", "left")
    asked = terms.select("term", "live").union(pointers.select(F.col("source").alias("term"), F.lit(None).cast("boolean")).join(terms, "term", "left_anti")).distinct()
    rows = asked.join(end, "term", "left")
    usable = F.when(F.col("live"), F.col("term")).when(F.col("_good"), F.col("target"))
    return rows.select("term", F.when(F.col("live"), "live").when(usable.isNotNull(), "replaced").when(F.col("live").isNull(), "unknown").otherwise("deprecated").alias("status"), usable.alias("usable"))


def representative_class(labels: DataFrame, favoured: DataFrame, bonus: int = 5) -> DataFrame:
    """node_id, class_id, score: the class that labels (node_id, class_id) give most often, with a bonus for favoured ones (class_id); then the least id."""
    counts = labels.groupBy("node_id", "class_id").agg(F.count("*").alias("n")).join(favoured.select("class_id").distinct().withColumn("_f", F.lit(bonus)), "class_id", "left")
    scored = counts.select("node_id", "class_id", (F.col("n") + F.coalesce("_f", F.lit(0))).alias("score"))
    order = Window.partitionBy("node_id").orderBy(F.desc("score"), "class_id")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
