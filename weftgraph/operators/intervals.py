"""Coordinate intervals with closed bounds: overlap, containment, nearest, lift-over, intersection, clusters.

Joins on ranges are joins on equal bins, whose width doubles from level to level. An interval's own
level is the first whose bins are at least as wide as it is, so it touches two of them at most. Of a
pair the one of the lower level is also listed at the level of the other, so that the pair meets
there, in the first bin that both touch: it comes once, whatever the lengths, and each interval is
listed at most twice for each level that there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.stretches import previous, ranged, reached, running
from weftgraph.plans.shared import checkpointed


def _levels(df: DataFrame, low: Column, high: Column, width: int) -> tuple[DataFrame, list[int]]:
    """df with the level of its intervals, and the levels that there are (at most 64)."""
    least = max(0, (width - 1).bit_length())
    df = df.withColumn("_level", F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(high - low + 1, F.lit(1)).cast("double")))).cast("int"))
    return df, sorted(r[0] for r in df.select("_level").distinct().collect() if r[0] is not None)


def _binned(df: DataFrame, low: Column, high: Column, others: list[int]) -> DataFrame:
    """df listed by `_at` and `_bin`: at its own level, and at the higher ones of the other side."""
    levels = F.array_union(F.array("_level"), F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_level")))
    df = df.withColumn("_at", F.explode(levels))
    wide = F.expr("shiftleft(1L, _at)")
    first = F.floor(low / wide)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.floor(high / wide))))


def overlapping(a: DataFrame, b: DataFrame, width: int = 256, within: int = 0) -> DataFrame:
    """Pairs of (seq, a_id, a_start, a_end) and (seq, b_id, b_start, b_end) that overlap or are at most `within` apart; width: of the narrowest bins."""
    a_low, a_high, b_low, b_high = F.col("a_start") - within, F.col("a_end") + within, F.col("b_start"), F.col("b_end")
    (a, a_levels), (b, b_levels) = _levels(a.where("a_start <= a_end"), a_low, a_high, width), _levels(b.where("b_start <= b_end"), b_low, b_high, width)
    left = _binned(a, a_low, a_high, b_levels).withColumnsRenamed({"_first": "_fa", "_level": "_la"})
    right = _binned(b, b_low, b_high, a_levels).withColumnsRenamed({"_first": "_fb", "_level": "_lb"})
    once = (F.col("_at") == F.greatest("_la", "_lb")) & (F.col("_bin") == F.greatest("_fa", "_fb"))
    pairs = left.join(right, ["seq", "_at", "_bin"]).where(once & (a_low <= b_high) & (a_high >= b_low))
    return pairs.drop("_at", "_bin", "_fa", "_fb", "_la", "_lb")


def contained(a: DataFrame, b: DataFrame, width: int = 256) -> DataFrame:
    """Pairs in which b's interval lies within a's."""
    return overlapping(a, b, width).where("b_start >= a_start AND b_end <= a_end")


def located_alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the same start and end."""
    same = b.withColumnsRenamed({"b_start": "a_start", "b_end": "a_end"})
    return a.join(same, ["seq", "a_start", "a_end"])


def gap(a_start: str = "a_start", a_end: str = "a_end", b_start: str = "b_start", b_end: str = "b_end") -> Column:
    """0 for overlap, negative with b on the left, positive with b on the right: the distance to its nearer end."""
    a0, a1, b0, b1 = map(F.col, (a_start, a_end, b_start, b_end))
    return F.when(b1 < a0, b1 - a0).when(b0 > a1, b0 - a1).otherwise(0)


def _beside(a: DataFrame, b: DataFrame, within: int, left: bool) -> DataFrame:
    """Pairs of each a with the b that end last before it (or, on the right, begin first behind it), at most `within` away.

    Both sides are put in one order of positions, in which the last end so far is a running maximum; so
    each a meets one place, and the b that have just that place, however many are within reach.
    """
    end, start = ("b_end", "a_start") if left else ("b_start", "a_end")
    sign = 1 if left else -1
    row = F.struct(*[F.col(f"`{c}`") for c in a.columns])
    spots = a.select("seq", (sign * F.col(start)).alias("_pos"), F.lit(0).alias("_kind"), row.alias("_row"))
    ends = b.select("seq", (sign * F.col(end)).cast(spots.schema["_pos"].dataType).alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(spots.schema["_row"].dataType).alias("_row")).distinct()
    order = [F.col("_pos").asc(), F.col("_kind").asc()]  # an end at the very start is an overlap
    dealt = ranged(spots.where("_pos IS NOT NULL").unionByName(ends.where("_pos IS NOT NULL")), ["seq"], order)
    near = running(dealt, ["seq"], order, F.when(F.col("_kind") == 1, F.col("_pos")), "_near", over="max")
    near = near.where((F.col("_kind") == 0) & (F.col("_pos") - F.col("_near") <= within)).select("_row.*", (sign * F.col("_near")).alias(end))
    return near.join(b, ["seq", end])


def nearest(a: DataFrame, b: DataFrame, within: int, width: int = 256, flank: bool = False, keep_all: bool = False) -> DataFrame:
    """For each a the closest b at most so far away, ties kept; with flank the closest on either side, with keep_all every one within reach."""
    if keep_all:
        return overlapping(a, b, width, within).withColumn("distance", gap())
    a, b = a.where("a_start <= a_end"), b.where("b_start <= b_end")
    pairs = overlapping(a, b, width)
    for left in (True, False):
        pairs = pairs.unionByName(_beside(a, b, within, left).select(*pairs.columns))
    pairs = pairs.withColumn("distance", gap())
    by = ["seq", "a_id", F.signum("distance")] if flank else ["seq", "a_id"]
    order = Window.partitionBy(*by).orderBy(F.abs("distance"))
    return pairs.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def nearest_counts(a: DataFrame, b: DataFrame, within: int) -> DataFrame:
    """seq, a_id, distance, n: how many b nearest() finds for each a, without a row for each pair.

    The b that end before an a, or begin behind it, are running sums in an order of positions, with the
    last of them as a running maximum; what is left of all b overlaps. So the work grows with the
    intervals, however many overlap.
    """
    a, b = a.where("a_start <= a_end").select("seq", "a_id", "a_start", "a_end"), b.where("b_start <= b_end")
    sides = []
    for left in (True, False):
        end, start = ("b_end", "a_start") if left else ("b_start", "a_end")
        sign = 1 if left else -1
        spots = a.select("seq", (sign * F.col(start)).cast("long").alias("_pos"), F.lit(0).alias("_kind"), "a_id", F.lit(0).cast("long").alias("_n"))
        ends = b.groupBy("seq", (sign * F.col(end)).cast("long").alias("_pos")).agg(F.count("*").alias("_n")).select("seq", "_pos", F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["a_id"].dataType).alias("a_id"), "_n")
        order = [F.col("_pos").asc(), F.col("_kind").asc()]  # an end at the very start is an overlap
        dealt = ranged(spots.unionByName(ends).where("seq IS NOT NULL"), ["seq"], order)
        dealt = reached(dealt, ["seq"], order, F.col("_n"), F.when(F.col("_kind") == 1, F.struct("_pos", "_n")), ("_out", "_near")).where("_kind = 0")
        away = sign * (F.col("_near._pos") - F.col("_pos"))
        sides.append(dealt.select("seq", "a_id", F.when(F.abs(away) <= within, away).alias("distance"), F.col("_near._n").alias("n"), F.col("_out"), F.lit(int(left)).alias("_row")))
    held = b.groupBy("seq").agg(F.count("*").alias("_all"))
    rows = sides[0].unionByName(sides[1]).join(held, "seq").withColumn("_over", F.col("_all") * F.col("_row") - F.col("_out"))
    rows = rows.groupBy("seq", "a_id", "distance").agg(F.sum("n").alias("n"), F.sum("_over").alias("_over"))  # an a_id may have several rows
    least = F.min(F.abs("distance"))
    at = [F.min(F.when(side, F.struct(F.abs("distance").alias("d"), "distance", "n"))) for side in (F.col("distance") < 0, F.col("distance") > 0)]
    best = rows.groupBy("seq", "a_id").agg(F.sum("_over").alias("_over"), least.alias("_least"), at[0].alias("_left"), at[1].alias("_right"))
    over = F.array(F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("distance"), F.col("_over").alias("n")))
    found = F.when(F.col("_over") > 0, over).otherwise(F.filter(F.array("_left", "_right"), lambda x: x.d == F.col("_least")))
    return best.select("seq", "a_id", F.explode(found).alias("x")).select("seq", "a_id", "x.distance", "x.n")


def nearest_blocks(a: DataFrame, b: DataFrame, within: int, width: int = 256) -> DataFrame:
    """a_id, b_id, distance between mappings made of blocks (rows that share an a_id or b_id): that of their two closest blocks.

    A b that lies in a gap between two blocks of a, without touching them, has a positive distance to the nearer one.
    """
    pairs = overlapping(a, b, width, within).withColumn("distance", gap())
    best = F.min(F.struct(F.abs("distance").alias("d"), F.col("distance").alias("s")))
    whole = a.groupBy("seq", "a_id").agg(F.min("a_start").alias("_low"), F.max("a_end").alias("_high"))
    got = pairs.groupBy("seq", "a_id", "b_id").agg(best.alias("x"), F.min("b_start").alias("_bs"), F.max("b_end").alias("_be"))
    inside = (F.col("_bs") >= F.col("_low")) & (F.col("_be") <= F.col("_high"))
    return got.join(whole, ["seq", "a_id"]).select("a_id", "b_id", F.when(inside, F.col("x.d")).otherwise(F.col("x.s")).alias("distance"))


def lifted(points: DataFrame, maps: DataFrame, width: int = 256) -> DataFrame:
    """point_id, map_id, seq2, pos2: positions (point_id, seq, pos) carried over (map_id, seq1, start1, end1, seq2, start2, end2, strand).

    A backward strand counts from the end; lengths that differ scale the offset.
    """
    a = points.select("seq", F.col("point_id").alias("a_id"), F.col("pos").alias("a_start"), F.col("pos").alias("a_end"))
    b = maps.select(F.col("seq1").alias("seq"), F.col("map_id").alias("b_id"), F.col("start1").alias("b_start"), F.col("end1").alias("b_end"), "start1", "end1", "seq2", "start2", "end2", "strand")
    hit = overlapping(a, b, width).withColumnsRenamed({"a_id": "point_id", "a_start": "pos", "b_id": "map_id"})
    return hit.select("point_id", "map_id", "seq2", carried(F.col("pos")).alias("pos2"))


def carried(pos: Column) -> Column:
    """A position on the first sequence, on the second one."""
    ratio = (F.col("end2") - F.col("start2") + 1) / (F.col("end1") - F.col("start1") + 1)
    offset = (pos - F.col("start1")) * ratio
    return F.when(F.col("strand") < 0, F.col("end2") - offset).otherwise(F.col("start2") + offset)


def intersections(a: DataFrame, b: DataFrame, width: int = 256) -> DataFrame:
    """a_id, b_id, seq, start, end, coverage: what two mappings share of a sequence, and its part of the shorter one."""
    pairs = overlapping(a, b, width)
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")) + 1
    return pairs.select("a_id", "b_id", "seq", start.alias("start"), end.alias("end"), ((end - start + 1) / shorter).alias("coverage"))


def bridged(a: DataFrame, b: DataFrame, width: int = 256, merge: int = 1) -> DataFrame:
    """a_id, b_id, seq1, s1, e1, seq2, s2, e2, strand, n, shared, gaps, coverage: from the far side of a over a shared sequence to that of b.

    Both are tables of blocks: id, seq, start, end on the shared sequence, seq2, start2, end2 on the
    other, strand. Blocks of one pair that lie within `merge` of each other on both far sides are
    joined; strands multiply; a block's far side is carried by its step ratio; gaps are the positions
    between the joined blocks, coverage is the shared part of the shorter mapping.
    """

    def renamed(df: DataFrame, c: str) -> DataFrame:
        return df.select("seq", F.col("id").alias(f"{c}_id"), F.col("start").alias(f"{c}_start"), F.col("end").alias(f"{c}_end"), *[F.col(x).alias(f"{c}_{x}") for x in ("seq2", "start2", "end2", "strand")])

    def far(c: str, pos: str) -> Column:
        ratio = (F.col(f"{c}_end2") - F.col(f"{c}_start2") + 1) / (F.col(f"{c}_end") - F.col(f"{c}_start") + 1)
        offset = (F.col(pos) - F.col(f"{c}_start")) * ratio
        return F.when(F.col(f"{c}_strand") < 0, F.col(f"{c}_end2") - offset).otherwise(F.col(f"{c}_start2") + offset)

    pairs = overlapping(renamed(a, "a"), renamed(b, "b"), width)
    pairs = pairs.withColumn("low", F.greatest("a_start", "b_start")).withColumn("high", F.least("a_end", "b_end"))
    for c, k in (("a", 1), ("b", 2)):
        pairs = pairs.withColumn(f"s{k}", F.least(far(c, "low"), far(c, "high"))).withColumn(f"e{k}", F.greatest(far(c, "low"), far(c, "high")))
    key = ["a_id", "b_id", "a_seq2", "b_seq2", "strand"]
    pairs = pairs.withColumn("strand", F.col("a_strand") * F.col("b_strand"))
    w = Window.partitionBy(*key).orderBy("low", "high")  # the blocks of one pair of mappings
    near = [(F.greatest(F.col(f"s{k}") - F.lag(f"e{k}").over(w), F.lag(f"s{k}").over(w) - F.col(f"e{k}")) <= merge) for k in (1, 2)]
    runs = pairs.withColumn("_new", F.when(F.lag("low").over(w).isNull() | ~(near[0] & near[1]), 1).otherwise(0)).withColumn("_between", F.greatest(F.lit(0), F.col("low") - F.lag("high").over(w) - 1))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy(*key, "_run").agg(
        *[f(c).alias(c) for c, f in (("s1", F.min), ("e1", F.max), ("s2", F.min), ("e2", F.max))], F.count("*").alias("n"),
        F.sum(F.col("high") - F.col("low") + 1).alias("shared"), F.sum(F.when(F.col("_new") == 0, F.col("_between")).otherwise(0)).alias("gaps"),
    )
    lengths = [df.groupBy(F.col("id").alias(f"{c}_id")).agg(F.sum(F.col("end") - F.col("start") + 1).alias(f"_{c}")) for c, df in (("a", a), ("b", b))]
    out = out.join(lengths[0], "a_id").join(lengths[1], "b_id").withColumn("coverage", F.col("shared") / F.least("_a", "_b"))
    return out.select("a_id", "b_id", F.col("a_seq2").alias("seq1"), "s1", "e1", F.col("b_seq2").alias("seq2"), "s2", "e2", "strand", "n", "shared", "gaps", "coverage")


def place_key(locations: DataFrame, key: str) -> DataFrame:
    """key, place: one text for each set of locations (seq, start, end), equal for sets that are equal."""
    one = F.concat_ws(":", "seq", "start", "end")
    return locations.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(one)), "|").alias("place"))


def clustered(df: DataFrame, by: list[str], start: str, most: int, tie: str) -> DataFrame:
    """df with `cluster`: a new one begins where the start is more than `most` after the one before."""
    order = [F.col(start).asc(), F.col(tie).asc()]
    dealt = previous(ranged(df, by, order), by, order, F.col(start), "_prev")
    new = F.coalesce((F.col(start) - F.col("_prev") > most).cast("int"), F.lit(1))
    return running(dealt, by, order, new, "cluster").drop("_prev", "_stretch")


def merged(df: DataFrame, by: list[str], start: str = "start", end: str = "end", slack: int = 1) -> DataFrame:
    """by, start, end, n: runs of intervals that overlap or touch (or are at most `slack` apart)."""
    order = [F.col(start).asc(), F.col(end).asc()]
    dealt = running(ranged(df, by, order), by, order, F.col(end), "_reach", "max", current=False)
    new = F.coalesce((F.col(start) > F.col("_reach") + slack).cast("int"), F.lit(1))
    runs = running(dealt.withColumn("_new", new), by, order, F.col("_new"), "_run")
    return runs.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def congealed(locations: DataFrame, by: list[str], most: int = 25, tie: str = "s2") -> DataFrame:
    """by, s1, e1, s2, e2, n: neighbouring locations (s1, e1, s2, e2) joined while their offsets differ by at most so much."""
    order = [F.col("s1").asc(), F.col("e1").asc(), F.col(tie).asc()]
    dealt = previous(ranged(locations, by, order), by, order, F.struct("e1", "e2"), "_prev")
    drift = F.abs((F.col("s2") - F.col("_prev.e2")) - (F.col("s1") - F.col("_prev.e1")))
    runs = running(dealt.withColumn("_new", F.coalesce((drift > most).cast("int"), F.lit(1))), by, order, F.col("_new"), "_run")
    return runs.groupBy(*by, "_run").agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"), F.count("*").alias("n")).drop("_run")


def bridge_score(score_a: Column, length_a: Column, score_b: Column, length_b: Column, shared: Column) -> Column:
    """The shorter mapping's score times how much of it is shared, to two places."""
    return F.round(F.when(length_a <= length_b, score_a * shared / length_a).otherwise(score_b * shared / length_b) + 1e-9, 2)  # halves go up


def coverage(df: DataFrame, by: list[str], low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """by, covered: the length of the union of the intervals within [low, high]."""
    cut = df.select(*by, F.greatest(F.col(start), low).alias("start"), F.least(F.col(end), high).alias("end")).where("start <= end")
    return merged(cut, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def contiguous(df: DataFrame, column: str) -> DataFrame:
    """low, high: runs of consecutive whole numbers. Numbers are dealt by ranges of 2^20, and runs joined over their borders."""
    block = F.shiftright(F.col(column).cast("long"), 20)
    rows = df.select(F.col(column).cast("long").alias("x"), block.alias("block")).distinct()
    inside = Window.partitionBy("block").orderBy("x")
    runs = rows.withColumn("_run", F.col("x") - F.row_number().over(inside)).groupBy("block", "_run").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return _over_borders(runs.select("low", "high"))


def _over_borders(runs: DataFrame) -> DataFrame:
    """Joins runs where one ends and the next begins at a border; only runs of whole blocks form chains."""
    border = 1 << 20
    at_low, at_high = F.pmod(F.col("low"), F.lit(border)) == 0, F.pmod(F.col("high") + 1, F.lit(border)) == 0
    inner = runs.where(~at_low & ~at_high)
    outer = merged(runs.where(at_low | at_high).withColumn("_k", F.lit(0)), ["_k"], "low", "high").select("low", "high")  # two rows a block at most
    return inner.select("low", "high").unionByName(outer)


def scaffolded(maps: DataFrame, queries: DataFrame, rounds: int = 2, bridges: DataFrame | None = None, width: int = 256) -> DataFrame:
    """query, start, end, seq, far_start, far_end, strand, score, via, round: what lies beyond a sequence's own mappings, over up to `rounds` bridges.

    maps: map_id, seq1, start1, end1, seq2, start2, end2, strand, score, read from either side; queries:
    seq. In each round the far side of what was found is the near side of the next mappings that
    overlap it: the shared stretch is carried back to the query and on to the far side, by step ratio
    and strand. A way comes to no sequence and takes no mapping twice. The score of a bridge is that of
    the shorter of the two on the shared sequence (of equals the lower), times the shared part of it,
    to two places; unscored mappings leave it unscored. With bridges (seq) only such sequences are
    gone on from.
    """
    sides = [maps.select("map_id", *[F.col(f"{c}{k}").alias(f"{side}_{c}") for side, k in zip(("near", "far"), order, strict=True) for c in ("seq", "start", "end")], "strand", "score") for order in ((1, 2), (2, 1))]
    both = checkpointed(sides[0].unionByName(sides[1]))
    b = both.select(F.col("near_seq").alias("seq"), F.col("map_id").alias("b_id"), F.col("near_start").alias("b_start"), F.col("near_end").alias("b_end"), *[F.col(c).alias(f"b_{c}") for c in ("far_seq", "far_start", "far_end", "strand", "score")])
    first = both.join(queries.select(F.col("seq").alias("near_seq")).distinct(), "near_seq", "left_semi").where("near_seq != far_seq")
    real = lambda c: F.col(c).cast("double")
    state = first.select(
        F.col("near_seq").alias("query"), real("near_start").alias("start"), real("near_end").alias("end"), F.col("far_seq").alias("seq"), real("far_start").alias("far_start"), real("far_end").alias("far_end"), "strand", real("score").alias("score"),
        F.array("map_id").alias("via"), F.array("near_seq", "far_seq").alias("seen"), F.lit(0).alias("round"),
    )
    out = None

    def carried_to(pos: Column, near: tuple[str, str], far: tuple[str, str], strand: str) -> Column:
        ratio = (F.col(far[1]) - F.col(far[0]) + 1) / (F.col(near[1]) - F.col(near[0]) + 1)
        offset = (pos - F.col(near[0])) * ratio
        return F.when(F.col(strand) < 0, F.col(far[1]) - offset).otherwise(F.col(far[0]) + offset)

    for k in range(1, rounds + 1):
        a = state if bridges is None else state.join(bridges.select("seq").distinct(), "seq", "left_semi")
        a = a.withColumnsRenamed({"far_start": "a_start", "far_end": "a_end"}).withColumn("a_id", F.col("query"))
        pairs = overlapping(a, b, width).where("NOT array_contains(via, b_id) AND NOT array_contains(seen, b_far_seq)")
        pairs = pairs.withColumn("low", F.greatest("a_start", real("b_start"))).withColumn("high", F.least("a_end", real("b_end")))
        here, there = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
        base = F.when(here < there, F.col("score")).when(here > there, F.col("b_score")).otherwise(F.least("score", "b_score"))
        part = (F.col("high") - F.col("low") + 1) / (F.least(here, there) + 1)
        both_scored = F.col("score").isNotNull() & F.col("b_score").isNotNull()
        for name, near, far, strand in (("q", ("a_start", "a_end"), ("start", "end"), "strand"), ("f", ("b_start", "b_end"), ("b_far_start", "b_far_end"), "b_strand")):
            x, y = (carried_to(F.col(p), near, far, strand) for p in ("low", "high"))
            pairs = pairs.withColumn(f"{name}_low", F.least(x, y)).withColumn(f"{name}_high", F.greatest(x, y))
        state = checkpointed(pairs.select(
            "query", F.col("q_low").alias("start"), F.col("q_high").alias("end"), F.col("b_far_seq").alias("seq"), F.col("f_low").alias("far_start"), F.col("f_high").alias("far_end"), (F.col("strand") * F.col("b_strand")).alias("strand"),
            F.when(both_scored, F.floor(0.5 + 100 * (base * part)) / 100).alias("score"), F.concat("via", F.array("b_id")).alias("via"), F.concat("seen", F.array("b_far_seq")).alias("seen"), F.lit(k).alias("round"),
        ))
        out = state if out is None else out.unionByName(state)
        if state.isEmpty():
            break
    return (state.where("false") if out is None else out).drop("seen")


def on_build(maps: DataFrame, build: str, least: float = 0.0, how_bad: float | None = None, keep_null: bool = True) -> DataFrame:
    """The places of terms (term, seq, build, start, end, strand, score) on one build: of at least this score, and no more than `how_bad` under the term's best there.

    An unscored place counts as the worst: it is kept without a limit on badness, or where a term has no scored one.
    """
    here = maps.where(F.col("build") == build)
    here = here.where(F.col("score") >= least) if not keep_null else here.where(F.col("score").isNull() | (F.col("score") >= least))
    if how_bad is None:
        return here
    best = here.groupBy("term").agg(F.max("score").alias("_best"))
    near = F.col("_best").isNull() | (F.round(F.col("_best") - F.col("score"), 9) <= how_bad)
    return here.join(best, "term").where(F.coalesce(near, F.lit(False))).drop("_best")


def features(maps: DataFrame, source: str, kind: str) -> DataFrame:
    """value: tab lines of features as annotation servers take them (seq, source, kind, start, end, score, strand, phase, group)."""
    return maps.select(F.concat_ws("\t", "seq", F.lit(source), F.lit(kind), F.least("start", "end").cast("string"), F.greatest("start", "end").cast("string"), F.when(F.col("score").isNull(), ".").otherwise(F.format_string("%.2f", F.col("score").cast("double"))), F.when(F.col("strand") < 0, "-").otherwise("+"), F.lit("."), F.concat(F.lit('term "'), F.col("term").cast("string"), F.lit('"'))).alias("value"))
