"""Walks over the graph: hierarchies, level-wise expansion, explicit paths, distances, clusters.

Loops go over levels, never over rows: each level is one join of the frontier with the edges and an
anti join with what was seen, checkpointed so that plans stay short and executors can be lost. The
driver holds one count per level.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.graph import read_as
from weftgraph.plans.shared import checkpointed, met_by_count, written


def closure(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the least depth of every ancestor, from links (child, parent); with most, of those up to this depth.

    Distances double with each round, so a chain of n links takes log2(n) rounds; cycles do no harm.
    With all ancestors up to depth d at hand, those up to 2 d lie above one at just d: so only these
    go on, and what they meet is new unless a shorter way leads there.
    """
    step = links.where("child IS NOT NULL AND parent IS NOT NULL AND child != parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    have, reach = written(step), 1
    while most is None or reach < most:
        upper = have.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = have.where(F.col("depth") == reach).join(upper, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        longer = longer.where(F.col("node") != F.col("ancestor"))
        if most is not None:
            longer = longer.where(F.col("depth") <= most)
        new = written(longer.join(have.select("node", "ancestor"), ["node", "ancestor"], "left_anti").groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        if new.isEmpty():
            break
        have, reach = have.unionByName(new), 2 * reach
    return have


def roots(links: DataFrame) -> DataFrame:
    """Nodes that are parents and nobody's children."""
    return links.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().join(links.where("parent IS NOT NULL").select(F.col("child").alias("node")), "node", "left_anti")


def common_parents(above: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor, distance: the shared ancestors with the least summed depth, ties kept; above is a closure."""
    with_self = above.unionByName(above.select("node").union(above.select("ancestor")).distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    up = written(with_self.groupBy("node").agg(F.collect_list(F.struct("ancestor", "depth")).alias("up")))  # as many as a node has ancestors
    both = pairs.join(up.select(F.col("node").alias("b"), F.col("up").alias("_b")), "b").join(up.select(F.col("node").alias("a"), F.col("up").alias("_a")), "a")
    met = F.flatten(F.transform("_a", lambda x: F.transform(F.filter("_b", lambda y: y["ancestor"] == x["ancestor"]), lambda y: F.struct(x["ancestor"].alias("ancestor"), (x["depth"] + y["depth"]).alias("distance")))))
    both = both.select("a", "b", met.alias("_met"))
    least = F.array_min(F.transform("_met", lambda m: m["distance"]))
    return both.select("a", "b", F.explode(F.filter("_met", lambda m: m["distance"] == least)).alias("_m")).select("a", "b", "_m.ancestor", "_m.distance")


def signed_distance(above: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance: positive where b is an ancestor of a, negative where it is a descendant, 0 for itself, else null."""
    up = above.select(F.col("node").alias("a"), F.col("ancestor").alias("b"), F.col("depth").alias("up"))
    down = above.select(F.col("ancestor").alias("a"), F.col("node").alias("b"), F.col("depth").alias("down"))
    return pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("up", -F.col("down"))).alias("distance"))


def shown_parents(taxonomy: DataFrame) -> DataFrame:
    """tax_id, parent_id, depth: ancestors that are not hidden, counted without the hidden ones."""
    above = closure(taxonomy.select(F.col("tax_id").alias("child"), F.col("parent_id").alias("parent")))
    shown = above.join(taxonomy.where("NOT hidden").select(F.col("tax_id").alias("ancestor")), "ancestor", "left_semi")
    order = Window.partitionBy("node").orderBy("depth")
    return shown.select(F.col("node").alias("tax_id"), F.col("ancestor").alias("parent_id"), F.row_number().over(order).alias("depth"))


def expand(
    links: DataFrame,
    seeds: DataFrame,
    recurse: int = 0,
    *,
    group_at: int | None = None,
    ungrouped: DataFrame | None = None,
    halt_nodes: DataFrame | None = None,
    halt_types: Sequence[int] = (),
    same_taxa: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """mine, other, type_id, dir, depth, grouped: edges met level by level from the seeds (node_id).

    links are oriented edges. No recursion still walks one hop. Where a node has `group_at` or more
    new edges of one reading these are kept (grouped) but not followed, unless the node is in
    `ungrouped` (node_id). Nodes in `halt_nodes` are kept but not followed either, and so are the ends
    of edges with `halt_types`, and edges between nodes of the frontier. With `same_taxa`
    (node_id, tax_id) a neighbour must share a taxon with the seeds, or have none. `limit` is per
    node and reading, by the neighbour's id.
    """
    frontier = checkpointed(seeds.select(F.col("node_id").alias("mine")).distinct())
    seen, found = frontier, None
    free = None if ungrouped is None else ungrouped.select(F.col("node_id").alias("mine")).distinct().withColumn("_free", F.lit(True))
    allowed = None if same_taxa is None else same_taxa.join(frontier.select(F.col("mine").alias("node_id")), "node_id", "left_semi").select("tax_id").distinct()
    for depth in range(recurse + 1):
        hop = links.join(frontier, "mine").select("mine", "other", "type_id", "dir")
        if found is not None:  # an edge is visited once, from whichever end
            done = found.select("mine", "other", "type_id").union(found.select("other", "mine", "type_id")).distinct()
            hop = hop.join(done, ["mine", "other", "type_id"], "left_anti")
        if allowed is not None:
            of = same_taxa.select(F.col("node_id").alias("other"), "tax_id")
            good = of.join(allowed, "tax_id", "left_semi").select("other").distinct()
            hop = hop.join(of.join(good, "other", "left_anti").select("other").distinct(), "other", "left_anti").select("mine", "other", "type_id", "dir")
        by_reading = Window.partitionBy("mine", "type_id", "dir")
        if limit is not None:
            hop = hop.withColumn("_n", F.row_number().over(by_reading.orderBy("other"))).where(F.col("_n") <= limit).drop("_n")
        grouped = F.lit(False) if group_at is None else F.count("*").over(by_reading) >= group_at
        hop = hop.withColumn("grouped", grouped).withColumn("depth", F.lit(depth + 1))
        if free is not None:
            hop = hop.join(free, "mine", "left").withColumn("grouped", F.col("grouped") & F.col("_free").isNull()).drop("_free")
        hop = checkpointed(hop)
        found = hop if found is None else found.unionByName(hop)
        following = hop.where(~F.col("grouped") & ~F.col("type_id").isin(list(halt_types))).select(F.col("other").alias("mine")).distinct().join(seen, "mine", "left_anti")
        if halt_nodes is not None:
            following = following.join(halt_nodes.select(F.col("node_id").alias("mine")), "mine", "left_anti")
        frontier = checkpointed(following)
        if depth == recurse or frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found.select("mine", "other", "type_id", "dir", "depth", "grouped")


def distances(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node_id, distance: the fewest edges from any seed, for every node within reach, or within so many edges."""
    level = written(seeds.select("node_id", F.lit(0).alias("distance")).distinct())
    out, step = level, written(links.select("mine", "other"))
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        nearer = level.select(F.col("node_id").alias("mine"))
        level = step.join(nearer, "mine", "left_semi").select(F.col("other").alias("node_id")).distinct().join(out, "node_id", "left_anti")
        level = written(level.select("node_id", F.lit(depth).alias("distance")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        if depth % 16 == 0:
            out = written(out)
    return out


def seeded(links: DataFrame, seeds: DataFrame, most: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """node, seed, distance: clusters that grow from all seeds (node_id) at once; a node belongs to its nearest seed, the least of equals.

    At most `most` edges away; with `through` (node_id) only such nodes are entered, so that clusters
    keep to the types of nodes, as links keep to those of edges.
    """
    level = checkpointed(seeds.select(F.col("node_id").alias("node"), F.col("node_id").alias("seed"), F.lit(0).alias("distance")).distinct())
    step, out = checkpointed(links.select("mine", "other").distinct()), level
    if through is not None:
        step = checkpointed(step.join(through.select(F.col("node_id").alias("other")), "other", "left_semi"))
    for distance in itertools.count(1) if most is None else range(1, most + 1):
        near = level.select(F.col("node").alias("mine"), "seed")
        reached = step.join(near, "mine").groupBy(F.col("other").alias("node")).agg(F.min("seed").alias("seed"))
        level = checkpointed(reached.join(out.select("node"), "node", "left_anti").withColumn("distance", F.lit(distance)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        if distance % 16 == 0:
            out = checkpointed(out)
    return out


def explicit(links: DataFrame, types: DataFrame, seeds: DataFrame, legs: Sequence[Sequence[str]], complete: bool = True) -> DataFrame:
    """root, node, path: walks that take one edge of each leg's readings (of types) in turn, without coming back to a node.

    Incomplete walks end where no edge of the next leg goes on; they are left out if `complete`.
    """
    walks = seeds.select(F.col("node_id").alias("root"), F.col("node_id").alias("node"), F.array("node_id").alias("path")).distinct()
    ended = []
    for leg in legs:
        step = links.where(read_as(types, *leg)).select(F.col("mine").alias("node"), "other").distinct()
        further = walks.join(step, "node").where(~F.array_contains("path", F.col("other")))
        if not complete:
            ended.append(walks.join(further.select("path").distinct(), "path", "left_anti").select("root", "node", "path"))
        walks = further.select("root", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"))
    return reduce(DataFrame.unionByName, ended, walks)


def telescope(walks: DataFrame, labels: DataFrame, classes: Sequence[int], nodes: DataFrame | None = None) -> DataFrame:
    """root, node: one edge for each walk's end in these classes; with nodes, only the end with the shortest name, then the first."""
    kept = walks.join(labels.where(F.col("class_id").isin(*classes)).select(F.col("node_id").alias("node")), "node", "left_semi").select("root", "node").where("root != node").distinct()
    if nodes is None:
        return kept
    order = Window.partitionBy("root").orderBy(F.length("name"), "name", "node")
    return kept.join(nodes.select(F.col("node_id").alias("node"), "name"), "node").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("root", "node")


def find_paths(links: DataFrame, start: DataFrame, end: DataFrame, weight: Column | None = None, max_legs: int = 6, slack: int = 0, least: float = 1e-8) -> DataFrame:
    """path, score: walks from any end back to any start in which each step comes nearer (by up to slack steps of none).

    A step's weight (0.95 unless given, a Column over type_id and dir) multiplies into the score.
    """
    away = written(distances(links, start, max_legs).select("node_id", F.col("distance").alias("there")))
    step = links.select("mine", "other", "type_id", "dir", (F.lit(0.95) if weight is None else weight).alias("weight")).groupBy("mine", "other").agg(F.max("weight").alias("weight"))
    step = step.join(away.withColumnRenamed("node_id", "other"), "other").join(away.select(F.col("node_id").alias("mine"), F.col("there").alias("here")), "mine")
    loss = F.greatest(F.lit(0), F.col("there") - F.col("here") + 1)
    step = written(step.where("here > 0").withColumn("loss", loss).where(F.col("loss") <= slack).drop("here"))  # no walk takes any other step, of which a hub has many
    walks = written(end.join(away, "node_id").select(F.col("node_id").alias("mine"), "there", F.array("node_id").alias("path"), F.lit(1.0).alias("score"), F.lit(0).alias("lost")))
    out = [walks.where("there = 0")]
    for leg in range(max_legs):
        left = max_legs - leg - 1  # legs after this one
        further = walks.where("there > 0").drop("there").join(step.where(F.col("there") <= left), "mine")
        further = further.withColumn("lost", F.col("lost") + F.col("loss")).where((F.col("lost") <= slack) & ~F.array_contains("path", F.col("other")))
        walks = written(further.select(F.col("other").alias("mine"), "there", F.concat("path", F.array("other")).alias("path"), (F.col("score") * F.col("weight")).alias("score"), "lost").where(F.col("score") >= least))
        if walks.isEmpty():
            break
        out.append(walks.where("there = 0"))
    return reduce(DataFrame.unionByName, out).select("path", "score")


def best_paths(paths: DataFrame) -> DataFrame:
    """The paths from each end that tie for the top score."""
    order = Window.partitionBy(F.col("path")[0]).orderBy(F.desc("score"))
    return paths.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each connected cluster of links (a, b), by alternating stars.

    Links of a node to itself count for nothing. Each half round meets links with the least neighbour
    of their node, by the measured number of links: a hub with more than one link in 4,096 by a
    broadcast of such hubs' least neighbours, so that its links stay where they are.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    e = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (now := mark(e)) != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        upward = e.select(F.col("v").alias("u"), F.col("u").alias("v"))  # the larger neighbours of each
        large = written(met_by_count(upward, least, ["u"], "n", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")))  # as many as links
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met_by_count(large, least, ["u"], "n", now[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def chased(pointers: DataFrame) -> DataFrame:
    """source, target: each target replaced by its own target until none changes.

    Of several targets the least counts, pointers to oneself do not. A cycle ends at its least node:
    the others on it, and all that lead into it, get that node, which has no target itself.
    Distances double with each round, so a chain of n pointers takes log2(n) rounds.
    """

    def doubled(have: DataFrame) -> DataFrame:
        onward = have.select(F.col("source").alias("target"), F.col("target").alias("further"))
        both = have.join(onward, "target", "left")
        return checkpointed(both.select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))

    first = checkpointed(pointers.where("source != target").groupBy("source").agg(F.min("target").alias("target")))
    have, before = first, -1
    while (now := (moved := doubled(have)).where("moved").count()) not in (0, before):  # a chain that goes on has nodes at every distance, so some arrive in each round
        have, before = moved.select("source", "target"), now
    ended = moved.where("NOT moved").select("source", "target")
    if now == 0:
        return ended
    have, size = moved.where("moved").select("source", "target"), -1  # all of these lead into cycles
    while (now := have.select("target").distinct().count()) != size:  # until only nodes on cycles are reached
        have, size = doubled(have).select("source", "target"), now
    ring = first.join(have.select(F.col("target").alias("source")).distinct(), "source", "left_semi").withColumn("least", F.col("source"))
    changed = True
    while changed:
        onward = ring.select(F.col("source").alias("target"), F.col("target").alias("further"), F.col("least").alias("lower"))
        next_ring = checkpointed(ring.join(onward, "target").select("source", F.col("further").alias("target"), F.least("least", "lower").alias("least"), (F.col("lower") < F.col("least")).alias("changed")))
        changed, ring = not next_ring.where("changed").isEmpty(), next_ring.drop("changed")
    met = have.join(ring.select(F.col("source").alias("target"), "least"), "target").select("source", F.col("least").alias("target"))
    return ended.unionByName(met.where("source != target"))


def versions(named: DataFrame, key: str = "accession", last: str = "version") -> DataFrame:
    """accession, version, name, prior: the unversioned name and each version up to the last, with the one before."""
    rows = named.select(key, F.explode(F.sequence(F.lit(0), F.col(last))).alias("version"))
    name = F.when(F.col("version") == 0, F.col(key)).otherwise(F.concat(key, F.lit("."), F.col("version")))
    prior = F.when(F.col("version") > 1, F.concat(key, F.lit("."), F.col("version") - 1)).when(F.col("version") == 1, F.col(key))
    return rows.select(key, "version", name.alias("name"), prior.alias("prior"))
