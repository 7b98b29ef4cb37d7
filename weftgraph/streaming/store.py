"""Keyed tables of assertions, changed by set and kill operations without rewriting what they do not touch.

A table (classes, taxa, lengths, mappings, or the history of edges) is dealt to hash partitions by
its names. A drop of operations rewrites only the partitions in which it changes a row, as new
folders; a manifest then says, for each partition, the version that holds it. Readers keep the
version they have, old versions can be read until they are removed, and a drop that is applied again
after a failure changes nothing.

Within a drop kills come before sets. A kill leaves out (as null) what may be anything; each kind of
table says which columns a kill must give, and which are enough with `override`. Operations that
break the rules are refused and handed back with the reason, the others applied.

One writer at a time: the second of two that write the same version fails, and can be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftgraph.operators.traverse import closure
from weftgraph.plans.shared import checkpointed, listed, located, shared_folder
from weftgraph.streaming.ingest import advanced, stale


@dataclass(frozen=True)
class Kind:
    """columns: what an operation gives; by: those that deal rows to partitions; needs: what a kill must give, one of these; override: what is enough with override."""

    columns: str
    by: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...]
    override: tuple[tuple[str, ...], ...] = ()
    optional: tuple[str, ...] = ()  # may be null in a set
    rule: str = "true"  # of sets
    stored: str | None = None  # columns of the table, where they are others

    @property
    def names(self) -> list[str]:
        return StructType.fromDDL(self.columns).names

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.stored or self.columns)


_NAMES2 = ("name1", "name2")
KINDS = {
    "class": Kind("name string, class_name string, authority string", ("name",), (("name", "authority"),), (("name",), ("authority",))),
    "taxon": Kind("name string, tax_id long, authority string", ("name",), (("name", "authority"),), rule="tax_id NOT IN (0, 12908)"),  # neither none nor undefined
    "length": Kind("name string, length long, authority string", ("name",), (("name", "authority"),), (("name",),), rule="length >= 0"),
    "mapping": Kind(
        "name1 string, name2 string, authority string, db string, start1 long, end1 long, start2 long, end2 long, strand int, score double", ("name1",),
        (("name1", "name2", "authority"), ("name1", "db", "authority"), ("name2", "db", "authority")), (("name1", "name2"), ("name1", "authority"), ("name2", "authority"), ("name1", "db"), ("name2", "db")),
        ("db", "score"), "start1 <= end1 AND start2 <= end2",
    ),
    "edge": Kind(
        "name1 string, name2 string, type_id int, authority string, at timestamp", _NAMES2, ((*_NAMES2, "type_id"),), (("name1", "type_id"), ("name2", "type_id"), ("name1", "authority"), ("name2", "authority")),
        stored="name1 string, name2 string, type_id int, authority string, live boolean, size int, dates array<timestamp>",
    ),
}

#: A cache of conversions: what a term of one space is in another, null for nothing, and when that was found.
CONVERSIONS = Kind("term_in string, ns_in string, ns_out string, term_out string, score double, updated timestamp", ("term_in",), ())


# --- versions ----------------------------------------------------------------------------------


def versions(spark: SparkSession, store: str) -> list[int]:
    """The versions that were written whole."""
    names = [n for n in listed(spark, f"{store}/manifest") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in names if "_SUCCESS" in listed(spark, f"{store}/manifest/{n}"))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> tuple[int, list[int | None]]:
    """(version, and for each partition the version that holds it, None for an empty one); a partition is a row, so their number bounds what the driver sees."""
    have = versions(spark, store)
    if not have or (version is not None and version not in have):
        raise ValueError(f"{store} has no version {version or ''}")
    v = have[-1] if version is None else version
    rows = spark.read.schema("part int, held int").json(f"{store}/manifest/v={v}").collect()
    return v, [held for _, held in sorted((r.part, r.held) for r in rows)]


def _written(spark: SparkSession, store: str, version: int, held: list[int | None]) -> None:
    spark.createDataFrame(list(enumerate(held)), "part int, held int").coalesce(1).write.json(f"{store}/manifest/v={version}", ignoreNullFields=False)


def create(spark: SparkSession, store: str, parts: int = 64) -> None:
    """An empty table of so many hash partitions, which stay that many."""
    _written(spark, store, 0, [None] * parts)


def part_of(kind: Kind, parts: int) -> Column:
    return F.pmod(F.xxhash64(*kind.by), F.lit(parts)).cast("int")


def read(spark: SparkSession, store: str, kind: Kind, version: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
    """The rows of a version, of some partitions only if these are given."""
    _, held = manifest(spark, store, version)
    paths = [f"{store}/data/v={held[p]}/part={p}" for p in (range(len(held)) if parts is None else parts) if held[p] is not None]
    return spark.read.schema(kind.schema).parquet(*paths) if paths else spark.createDataFrame([], kind.schema)


def replace(spark: SparkSession, store: str, kind: Kind, parts: Iterable[int], rows: DataFrame) -> int:
    """A new version in which these partitions hold these rows; the others stay the files they are."""
    v, held = manifest(spark, store)
    path = f"{store}/data/v={v + 1}"
    names = kind.schema.names
    rows.select(*names, part_of(kind, len(held)).alias("part")).repartition("part").write.partitionBy("part").parquet(path)
    filled = {int(n[5:]) for n in listed(spark, path) if n.startswith("part=")}
    for p in parts:
        held[p] = v + 1 if p in filled else None
    _written(spark, store, v + 1, held)
    return v + 1


def remove_versions(spark: SparkSession, store: str, keep: int = 1) -> list[int]:
    """Removes all but the last versions, with the files that none of those holds; returns the removed ones."""
    have = versions(spark, store)
    gone, kept = have[:-keep], have[-keep:]
    used = {(v, p) for k in kept for p, v in enumerate(manifest(spark, store, k)[1]) if v is not None}
    for v in gone:
        at, fs = located(spark, f"{store}/manifest/v={v}")
        fs.delete(at, True)
    for name in listed(spark, f"{store}/data"):
        v = int(name[2:])
        for part in listed(spark, f"{store}/data/{name}"):
            if v < kept[-1] and part.startswith("part=") and (v, int(part[5:])) not in used:
                at, fs = located(spark, f"{store}/data/{name}/{part}")
                fs.delete(at, True)
    return gone


# --- operations --------------------------------------------------------------------------------


def checked(operations: DataFrame, kind: Kind) -> DataFrame:
    """operations (op, override and the kind's columns) with `why` they are refused, or null.

    A set must give all columns but optional ones and keep the kind's rule; a kill must give one of
    the groups of columns that the kind needs, or with override one of those that are then enough.
    """
    given = lambda cs: reduce(Column.__and__, [F.col(c).isNotNull() for c in cs])
    some = lambda groups: reduce(Column.__or__, [given(g) for g in groups], F.lit(False))
    whole = given([c for c in kind.names if c not in kind.optional])
    enough = some(kind.needs) | (F.coalesce("override", F.lit(False)) & some(kind.override))
    broken = ~F.coalesce(F.expr(kind.rule), F.lit(False))
    why = F.when(F.col("op") == "set", F.when(~whole, "incomplete").when(broken, "not allowed")).when(F.col("op") == "kill", F.when(~enough, "too little given")).otherwise("no such operation")
    return operations.withColumn("why", F.when(F.col("op").isNull(), "no such operation").otherwise(why))


def _shape(columns: list[str]) -> Column:
    """Which of the columns are given, as bits."""
    return sum((F.col(c).isNotNull().cast("int") * (1 << k) for k, c in enumerate(columns)), F.lit(0))


def by_shape(operations: DataFrame, columns: list[str]) -> list[tuple[list[str], DataFrame]]:
    """(columns that are given, the operations that give just these); as many as the kind has groups, and what is given beyond them."""
    shape = _shape(columns)
    masks = sorted(r.m for r in operations.select(shape.alias("m")).where("m > 0").distinct().collect())
    return [([c for k, c in enumerate(columns) if m >> k & 1], operations.where(shape == m)) for m in masks]


def matching(rows: DataFrame, kills: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a kill matches, once for each set of columns that kills give; a null in a kill matches anything."""
    out = [rows.join(some.select(*on).distinct(), on, "left_semi").select(*rows.columns) for on, some in by_shape(kills, columns)]
    return reduce(DataFrame.union, out) if out else rows.limit(0)


def without_matching(rows: DataFrame, kills: DataFrame, columns: list[str]) -> DataFrame:
    for on, some in by_shape(kills, columns):
        rows = rows.join(some.select(*on).distinct(), on, "left_anti").select(*rows.columns)
    return rows


def deep(kills: DataFrame, classes: DataFrame) -> DataFrame:
    """kills of classes, each for all classes below as well; classes (class_name, parent)."""
    below = closure(classes.select(F.col("class_name").alias("child"), "parent")).select(F.col("ancestor").alias("class_name"), F.col("node").alias("_below"))
    more = kills.join(below, "class_name").withColumn("class_name", F.col("_below")).select(*kills.columns)
    return kills.unionByName(more)


def _touched(spark: SparkSession, store: str, kind: Kind, kills: DataFrame, sets: DataFrame, parts: int) -> list[int]:
    """Partitions that sets, or kills that give all names they are dealt by, fall in; and those with rows that open kills match."""
    named = " AND ".join(f"{c} IS NOT NULL" for c in kind.by)
    place = part_of(kind, parts).alias("part")
    found = sets.select(place).union(kills.where(named).select(place)).distinct()
    open_ = kills.where(f"NOT ({named})")
    if not open_.isEmpty():
        columns = [c for c in kind.names if c in kind.schema.names]
        found = found.union(matching(read(spark, store, kind), open_, columns).select(place)).distinct()
    return sorted(r.part for r in found.collect())  # one for each partition at most


def _labelled(old: DataFrame, kills: DataFrame, sets: DataFrame, kind: Kind) -> DataFrame:
    """Rows after a drop, where a row is all its columns."""
    names = kind.names
    return without_matching(old.select(*names), kills, names).union(sets.select(*names)).distinct()


def _edges(old: DataFrame, kills: DataFrame, sets: DataFrame, kind: Kind) -> DataFrame:
    """The history of edges after a drop: a kill without an authority, or without a name, is one for each that holds the edge."""
    key = ["name1", "name2", "type_id", "authority"]
    open_ = kills.where(" OR ".join(f"{c} IS NULL" for c in key))
    ops = [sets.select(*key, "at", F.lit("set").alias("op")), kills.where(" AND ".join(f"{c} IS NOT NULL" for c in key)).select(*key, "at", F.lit("kill").alias("op"))]
    for on, some in by_shape(open_, key):
        when = some.groupBy(*on).agg(F.max("at").alias("at"))
        ops.append(old.where("live").select(*key).join(when, on).select(*key, "at", F.lit("kill").alias("op")))
    return advanced(old, reduce(DataFrame.unionByName, ops))


def apply(spark: SparkSession, store: str, kind: Kind, operations: DataFrame) -> tuple[int, DataFrame]:
    """(version, refused operations with the reason) after a drop of operations; the version stays if nothing changes."""
    ops = checkpointed(checked(operations, kind).dropDuplicates())
    good = ops.where("why IS NULL")
    kills, sets = good.where("op = 'kill'"), good.where("op = 'set'")
    v, held = manifest(spark, store)
    touched = _touched(spark, store, kind, kills, sets, len(held))
    if touched:
        old = read(spark, store, kind, v, touched)
        fold: Callable = _edges if kind.stored else _labelled
        new = checkpointed(fold(old, kills, sets, kind).withColumn("part", part_of(kind, len(held))))
        mark = lambda df: df.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*kind.schema.names).cast("decimal(20,0)")).alias("h"))
        before, after = mark(old.withColumn("part", part_of(kind, len(held)))), mark(new).withColumnsRenamed({"n": "n2", "h": "h2"})
        same = F.col("n").eqNullSafe(F.col("n2")) & F.col("h").eqNullSafe(F.col("h2"))
        changed = [r.part for r in before.join(after, "part", "full_outer").where(~same).select("part").collect()]
        if changed:
            v = replace(spark, store, kind, changed, new.where(F.col("part").isin(changed)).drop("part"))
    return v, ops.where("why IS NOT NULL")


def ingest(spark: SparkSession, source: str, store: str, kind: Kind, checkpoint: str, refused: str | None = None) -> StreamingQuery:
    """Applies all operation files (JSON lines) dropped so far, a drop at a time, then stops; with `refused`, what is refused is added to the files there."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _, bad = apply(session, store, kind, batch)
        if refused:
            bad.write.mode("overwrite").json(f"{refused}/batch={number}")

    stream = spark.readStream.schema(f"op string, override boolean, {kind.columns}").json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh(spark: SparkSession, parts: int = 16) -> str:
    """An empty store in a new folder that driver and executors share."""
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    create(spark, store, parts)
    return store


def preview(spark: SparkSession, store: str, kind: Kind, operations: DataFrame) -> DataFrame:
    """operations with `effect` and `n_rows`, without doing anything: what each would do to the current version by itself.

    A set is `new` or `held` already; a kill `removes` so many rows or finds `nothing`; one that breaks the rules is `refused`.
    """
    columns = [c for c in kind.names if c in kind.schema.names]
    rows = read(spark, store, kind)
    held = rows.where("live") if kind.stored else rows
    ops = checked(operations, kind)
    blank = _shape(columns) == 0
    out = [ops.where(F.col("why").isNotNull() | blank).withColumn("n_rows", F.lit(0).cast("long"))]
    for on, some in by_shape(ops.where("why IS NULL"), columns):
        found = held.groupBy(*on).agg(F.count("*").alias("n_rows"))
        out.append(some.join(found, on, "left").select(*ops.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows")))
    effect = F.when(F.col("why").isNotNull(), "refused").when(F.col("op") == "set", F.when(F.col("n_rows") > 0, "held").otherwise("new")).when(F.col("n_rows") > 0, "removes").otherwise("nothing")
    return reduce(DataFrame.unionByName, out).withColumn("effect", effect)


# --- caches ------------------------------------------------------------------------------------


def churned(spark: SparkSession, store: str, convert: Callable[[DataFrame, str, str], DataFrame], now: str, days: int, redo_null: int | None = None) -> tuple[int, int]:
    """(version, stale keys) of a store of CONVERSIONS after what is stale in it was computed anew.

    Stale is a key (term_in, ns_in, ns_out) with a row older than so many days, or, if unscored, than
    redo_null. convert takes terms (term) and the two spaces, and returns input, output and score; a
    term for which it finds nothing gets a row without output. Only partitions with stale keys are
    rewritten.
    """
    kind, key = CONVERSIONS, ["term_in", "ns_in", "ns_out"]
    cached = read(spark, store, kind)
    old = checkpointed(stale(cached, now, days, redo_null).select(*key).distinct())
    n = old.count()
    v, held = manifest(spark, store)
    if not n:
        return v, 0
    new = None
    for ns_in, ns_out in old.select("ns_in", "ns_out").distinct().collect():  # pairs of a vocabulary of spaces
        asked = old.where((F.col("ns_in") == ns_in) & (F.col("ns_out") == ns_out)).select(F.col("term_in").alias("term"))
        found = convert(asked, ns_in, ns_out).select(F.col("input").alias("term"), "output", "score")
        rows = asked.join(found, "term", "left").select(F.col("term").alias("term_in"), F.lit(ns_in).alias("ns_in"), F.lit(ns_out).alias("ns_out"), F.col("output").cast("string").alias("term_out"), F.col("score").cast("double").alias("score"), F.lit(now).cast("timestamp").alias("updated"))
        new = rows if new is None else new.unionByName(rows)
    touched = sorted(r.part for r in old.select(part_of(kind, len(held)).alias("part")).distinct().collect())
    kept = read(spark, store, kind, v, touched).join(old, key, "left_anti")
    return replace(spark, store, kind, touched, checkpointed(kept.select(*kind.names).unionByName(new))), n
