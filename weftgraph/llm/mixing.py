"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's shuffled documents, end to end, are cut into blocks of equally many words. Slots of
the mix map golden-ratio points through the cumulative target shares to a source; the slot's rank
within its source names a block, round and round. The last slot of a source takes only what its
target leaves. DataFrame functions only; no step brings a source's rows, or all sources, into one
task: sums over what comes before are made chunk by chunk. Sources meet their documents and slots in
plain joins, whose kind Spark takes from the sizes of the tables.

Null and empty texts have size 0 and are taken 0 times; a very long text is a document like others,
cut by the blocks' borders alone. A null source is a source of its own, the last. Rows that repeat a
doc_id are documents of their own, in the order of a hash of their texts; equal rows are
interchangeable, so that reruns agree. An empty table gives an empty mix. Columns other than doc_id,
source and text are not read; mixed_documents hands them on, whatever their names, but for those
named like its own four, which take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, parts_of, whole, written

_GOLDEN = 0.6180339887498949


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _prefix(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the earlier rows of its group, summed chunk by chunk; order starts with `chunk`."""
    chunk = df.groupBy(*by, "chunk").agg(F.sum(value).alias("_n"))
    whole = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunk.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("chunk").alias("_chunk"), F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_base"))
    same = F.col("chunk") == F.col("_chunk")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(base, same)
    return joined.select(*df.columns, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long").alias(name))


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df in the order of these columns, with the number of the stretch that a row is in as `chunk`."""
    return checkpointed(df.drop("chunk").repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()))


def targets(by_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, weight, target (and chunk, in the order of the sources) for (source, source_size): weights repeat over the sources in order.

    The target is weight * level, at most `most` times the size, with the level at which all targets
    sum to all sizes: sources are filled up in the order of the level at which they are full.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = _prefix(_ranged(by_source, *by_name), [], by_name, F.lit(1), "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    w = checkpointed(ranked.select("chunk", "source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")).withColumn("full", F.col("cap") / F.col("weight")))
    sizes_sum, weights_sum = w.agg(F.sum("source_size"), F.sum("weight")).first()
    by_full = [F.col("full").asc(), *by_name]
    filled = _prefix(_prefix(_ranged(w, *by_full), [], by_full, F.col("cap"), "caps"), [], by_full, F.col("weight"), "weights")
    level = (F.lit(sizes_sum) - F.col("caps")) / (F.lit(weights_sum) - F.col("weights"))  # the level, were this source and the later ones not full
    found = filled.select("full", level.alias("level")).where("level <= full").agg(F.min(F.struct("full", "level"))["level"]).first()[0]
    return w.select("chunk", "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(found).cast("double")).alias("target"))


def shuffled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, tie (a hash of the text) and the words before the document in its source's shuffled order.

    The shuffle orders by md5 of seed and doc_id, then doc_id and the hash of the text.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", sizes(F.col("text")).alias("size"), hashed.alias("h"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("chunk", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))  # 4096 of them
    return _prefix(rows, ["source"], [F.col("h"), F.col("doc_id"), F.col("tie")], F.col("size"), "start")


def plan(by_source: DataFrame, block_words: int, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """targets() with words (the whole-number target), block (words in each), blocks, slots (that the target takes)."""
    t = targets(by_source, weights, most).select("*", F.floor(F.col("target")).cast("long").alias("words"))
    block = F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.floor(F.col("source_size") / block_words))).cast("long")
    t = t.select("*", F.greatest(F.lit(1).cast("long"), block).alias("block"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))  # whole words can make fewer blocks
    laps = F.when(F.col("source_size") > 0, F.expr("words div greatest(source_size, 1)")).otherwise(0)
    slots = laps * F.col("blocks") + F.ceil((F.col("words") - laps * F.col("source_size")) / F.col("block"))
    return t.select("*", slots.cast("long").alias("slots"))


def schedule(planned: DataFrame) -> DataFrame:
    """slot, source, rank, block number and words: the mix in order, one row per block that it takes.

    A tenth more points than slots are drawn; the first ones of each source count, and what the
    points leave out of a source's slots follows at the end.
    """
    spark = planned.sparkSession
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long")).first()[0]
    drawn = total + total // 10 + 16 if total else 0
    arcs = _prefix(planned, [], [F.col("source").asc_nulls_last()], F.col("slots"), "before")
    upto = F.col("before") + F.col("slots")
    arcs = arcs.select("source", "slots", (F.col("before") / F.lit(max(1, total))).alias("low"), F.when(upto == total, 2.0).otherwise(upto / F.lit(max(1, total))).alias("high"))
    step = 1 << 20
    turn = (step * _GOLDEN) % 1.0
    point = (F.expr(f"id div {step}") * turn + F.pmod(F.col("id"), F.lit(step)) * _GOLDEN) % 1.0
    cells = 4096  # arcs are found by the cell of the point, so that the join is on equal keys
    points = spark.range(drawn).select(F.col("id").alias("slot"), point.alias("x"), F.expr(f"CAST(id * {cells} div {max(1, drawn)} AS INT)").alias("chunk"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    split = arcs.select("source", "slots", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)).cast("int"))).alias("cell"))
    slots = points.join(split, "cell").where("low <= x AND x < high").select("slot", "source", "slots", "chunk")
    ranked = _prefix(slots, ["source"], [F.col("slot")], F.lit(1), "rank").where("rank < slots").select("slot", "source", "rank")
    got = ranked.groupBy("source").agg(F.count("*").alias("got")).select(F.col("source").alias("_s"), "got")
    short = planned.join(got, planned["source"].eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("got", F.lit(0)).alias("got"), "slots").where("got < slots")
    extra = short.select((F.lit(drawn) + F.xxhash64("source").bitwiseAND(F.lit(0xFFFF))).alias("slot"), "source", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    p = planned.select(F.col("source").alias("_s"), "source_size", "blocks", "block", "words")
    rows = ranked.unionByName(extra).join(p, F.col("source").eqNullSafe(F.col("_s")))
    number = F.pmod(F.col("rank"), F.col("blocks"))
    length = F.least(F.col("block"), F.col("source_size") - number * F.col("block"))
    lap = F.expr("rank div blocks") * F.col("source_size") + number * F.col("block")
    return rows.select("slot", "source", "rank", number.alias("number"), F.least(length, F.col("words") - lap).cast("long").alias("length"), "block")


def _mixed(docs: DataFrame, block_words: int = 4096, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    placed = shuffled(docs, seed)
    planned = written(plan(docs.groupBy("source").agg(F.sum(sizes(F.col("text"))).alias("source_size")), block_words, weights, most))
    slots = schedule(planned)
    uses = slots.groupBy(F.col("source").alias("_s"), "number").agg(F.collect_list("length").alias("lengths"))  # at most `most` + 1
    blocks = planned.select(F.col("source").alias("_s"), "block")
    pieces = placed.where("size > 0").join(blocks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    last = F.expr("(start + size - 1) div block")
    pieces = pieces.select("*", F.explode(F.sequence(F.expr("start div block"), last)).alias("number"))
    low, high = F.greatest(F.col("start"), F.col("number") * F.col("block")), F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * F.col("block"))
    pieces = pieces.select("doc_id", "source", "size", "tie", "start", "number", (low - F.col("number") * F.col("block")).alias("a"), (high - F.col("number") * F.col("block")).alias("b"))
    hit = pieces.join(uses, (pieces["number"] == uses["number"]) & pieces["source"].eqNullSafe(uses["_s"]), "left")
    words = F.aggregate(F.coalesce("lengths", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(0), F.least(F.col("b"), x) - F.col("a")))
    taken = hit.groupBy("doc_id", "source", "size", "tie", "start").agg(F.sum(words).alias("taken"))
    rows = taken.unionByName(placed.where("size = 0").select("doc_id", "source", "size", "tie", "start", F.lit(0).cast("long").alias("taken")))
    t = planned.select(F.col("source").alias("_s"), "source_size", "target")
    return rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "tie", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    return _mixed(docs, **options).drop("tie")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the words taken from each as `taken`, and their size, source_size and target.

    Of equal rows the one of which most is taken counts for all.
    """
    chosen = _mixed(docs, **options).where("taken > 0").groupBy("doc_id", "source", "tie", "size", "source_size", "target").agg(F.max("taken").alias("taken"))
    rows = docs.select(whole(docs).alias("row"), docs["doc_id"].alias("_id"), docs["source"].alias("_source"), F.xxhash64(docs["text"]).alias("_tie"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_tie") == F.col("tie"))
    own = ["size", "source_size", "target", "taken"]
    return rows.join(chosen, same).select(*parts_of("row", [c for c in docs.columns if c not in own]), *own)
