"""One-hop edge queries: from a set of nodes to their neighbours, with filters on edge and neighbour.

Every filter on another table is a semi or an anti join, so rows are never multiplied by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.traverse import closure
from weftgraph.plans.graph import Graph, oriented, read_as, symmetric

_EDGE = ["name1", "name2", "type_id"]


def ends(rows: DataFrame) -> DataFrame:
    """Oriented rows with the edge's own ends beside them."""
    back = F.col("dir") < 0
    return rows.withColumn("name1", F.when(back, F.col("other")).otherwise(F.col("mine"))).withColumn("name2", F.when(back, F.col("mine")).otherwise(F.col("other")))


def _by_edge(rows: DataFrame, edges: DataFrame, how: str, either_way: Sequence[int]) -> DataFrame:
    """Semi or anti join of oriented rows with edges; edges of symmetric types may be stored either way."""
    back = edges.where(F.col("type_id").isin(list(either_way))).select("name2", "name1", "type_id")
    return ends(rows).join(edges.select(*_EDGE).union(back), _EDGE, how).select(*rows.columns)


def descendants(classes: DataFrame, names: Sequence[str]) -> DataFrame:
    """class_id of these classes and all below them."""
    named = classes.where(F.col("class_name").isin(list(names))).select("class_id")
    above = closure(classes.select(F.col("class_id").alias("child"), F.col("parent_id").alias("parent")))
    return named.union(above.join(named.withColumnRenamed("class_id", "ancestor"), "ancestor", "left_semi").select("node")).distinct()


@dataclass(frozen=True)
class TagFilter:
    """Edges with metadata under this tag whose value satisfies the condition; a null value never does."""

    tag: str
    value: Column

    def edges(self, meta: DataFrame) -> DataFrame:
        return meta.where((F.col("tag") == self.tag.upper()) & F.coalesce(self.value, F.lit(False)))


def edge_query(
    g: Graph,
    seeds: DataFrame | None = None,
    *,
    reads: Sequence[str] = (),
    space: int | None = 1,
    dead_too: bool = False,
    keep_authority: Sequence[str] = (),
    toss_authority: Sequence[str] = (),
    keep_class: Sequence[str] = (),
    toss_class: Sequence[str] = (),
    keep_taxa: Sequence[int] = (),
    keep_space: Sequence[int] = (),
    tags: Sequence[TagFilter] = (),
    connects: DataFrame | None = None,
    connects_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """mine, other, type_id, dir, live, space_id of the edges of the seeds (node_id), or of all nodes.

    Edges are live and in space 1 unless told otherwise. Authorities count where their history is
    live. Classes stand for all classes below them, taxa for themselves alone. `connects` asks that
    the neighbour also touches one of these nodes by a live edge. `limit` is per seed and reading, in
    the order of the neighbour's id, so that results are the same each time. A reading may name the
    space of its edges (`#2#supplies`), which then counts instead of `space`.
    """
    rows = oriented(g.edges, g.types)
    if space is not None:
        own = [r for r in reads if not r.startswith("#")]
        named = [r for r in reads if r.startswith("#")]
        here = F.col("space_id") == space
        rows = rows.where((here & (read_as(g.types, *own) if own else F.lit(not named))) | read_as(g.types, *named) if named else here)
    if not dead_too:
        rows = rows.where("live")
    if reads:
        rows = rows.where(read_as(g.types, *reads))
    if seeds is not None:
        rows = rows.join(seeds.select(F.col("node_id").alias("mine")).distinct(), "mine", "left_semi")
    said = g.history.where("live")
    either_way = symmetric(g.types) if keep_authority or toss_authority or tags else []
    if keep_authority:
        rows = _by_edge(rows, said.where(F.col("authority").isin(*keep_authority)), "left_semi", either_way)
    if toss_authority:
        rows = _by_edge(rows, said.where(F.col("authority").isin(*toss_authority)), "left_anti", either_way)
    labels = g.labels.select(F.col("node_id").alias("other"), "class_id")
    if keep_class:
        rows = rows.join(labels.join(descendants(g.classes, keep_class), "class_id", "left_semi"), "other", "left_semi")
    if toss_class:
        rows = rows.join(labels.join(descendants(g.classes, toss_class), "class_id", "left_semi"), "other", "left_anti")
    if keep_taxa:
        rows = rows.join(g.taxa.where(F.col("tax_id").isin(*keep_taxa)).select(F.col("node_id").alias("other")), "other", "left_semi")
    if keep_space:
        rows = rows.join(g.nodes.where(F.col("space_id").isin(*keep_space)).select(F.col("node_id").alias("other")), "other", "left_semi")
    for t in tags:
        rows = _by_edge(rows, t.edges(g.meta), "left_semi", either_way)
    if connects is not None:
        touching = oriented(g.edges, g.types).where(F.col("live") & (read_as(g.types, *connects_by) if connects_by else F.lit(True)))
        touching = touching.join(connects.select(F.col("node_id").alias("mine")), "mine", "left_semi")
        rows = rows.join(touching.select("other").distinct(), "other", "left_semi")
    if limit is not None:
        order = Window.partitionBy("mine", "type_id", "dir").orderBy("other")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return rows.select("mine", "other", "type_id", "dir", "live", "space_id")


def named(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Adds the name of each id column as `<column>_name`."""
    for c in columns:
        rows = rows.join(nodes.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return rows


def partly_specified(edges: DataFrame, name1: Column | None = None, name2: Column | None = None, **given: int) -> DataFrame:
    """Edges that fit whichever of name1, name2 (conditions), type_id and space_id are given."""
    for c in (name1, name2, *(F.col(k) == v for k, v in given.items() if v is not None)):
        edges = edges if c is None else edges.where(c)
    return edges


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that join the nodes of a pair (a, b), whichever way round."""
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    wanted = pairs.select(low, high).distinct()
    return edges.withColumn("low", F.least("name1", "name2")).withColumn("high", F.greatest("name1", "name2")).join(wanted, ["low", "high"], "left_semi").drop("low", "high")


def connect(edges: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Live edges with one end in left (node_id) and the other in right, or both in left."""
    right = left if right is None else right
    a = left.select(F.col("node_id").alias("name1")).distinct()
    b = right.select(F.col("node_id").alias("name2")).distinct()
    there = edges.where("live").join(a, "name1", "left_semi").join(b, "name2", "left_semi")
    back = edges.where("live").join(a.withColumnRenamed("name1", "name2"), "name2", "left_semi").join(b.withColumnRenamed("name2", "name1"), "name1", "left_semi")
    return there.unionByName(back.select(*there.columns)).distinct()


def leaves_only(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Drops each output of an input that is a direct parent of another of its outputs; parents: (child, parent)."""
    above = rows.select("input", F.col("output").alias("child")).join(parents, "child").select("input", F.col("parent").alias("output"))
    return rows.join(above, ["input", "output"], "left_anti")


def add_missing(rows: DataFrame, known: DataFrame, key: Sequence[str], **values: Column) -> DataFrame:
    """known and the rows whose key it lacks, with these values in the other columns."""
    new = rows.select(*key).distinct().join(known.select(*key), list(key), "left_anti")
    return known.unionByName(new.select(*[F.col(c) if c in key else values[c].alias(c) for c in known.columns]))
