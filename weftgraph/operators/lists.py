"""Tables of inputs, outputs and scores: conversion chains, best rows, grids, ranks, set columns."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.edges import leaves_only
from weftgraph.operators.stretches import numbered
from weftgraph.operators.traverse import closure
from weftgraph.plans.shared import checkpointed


def chain(rules: Sequence[DataFrame], how: str = "product") -> DataFrame:
    """input, output, score, via: rules (term_in, term_out, score) composed in order.

    Our own rule for scores: the product, or the least, of the steps'; an unscored step leaves the
    chain unscored. Of several ways to an output the best-scored counts, and of these the one whose
    terms come first.
    """
    rows = rules[0].select(F.col("term_in").alias("input"), F.col("term_out").alias("output"), "score", F.array("term_out").alias("via"))
    for r in rules[1:]:
        step = r.select(F.col("term_in").alias("output"), F.col("term_out").alias("_to"), F.col("score").alias("_s"))
        joint = F.col("score") * F.col("_s") if how == "product" else F.when(F.col("score").isNotNull() & F.col("_s").isNotNull(), F.least("score", "_s"))
        rows = rows.join(step, "output").select("input", F.col("_to").alias("output"), joint.alias("score"), F.concat("via", F.array("_to")).alias("via"))
    best = F.max_by(F.struct("score", "via"), F.struct(F.coalesce("score", F.lit(-1.0)), F.transform("via", lambda x: -x) if dict(rows.dtypes)["via"] != "array<string>" else F.col("score")))
    return rows.groupBy("input", "output").agg(best.alias("b")).select("input", "output", "b.score", "b.via")


def keep_best(rows: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """The rows with each key's top score, ties kept; unscored rows count only where nothing is scored."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last())
    return rows.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def floor_score(rows: DataFrame, least: float, keep_null: bool = True, score: str = "score") -> DataFrame:
    """Rows with at least this score; unscored ones by choice."""
    good = F.col(score) >= least
    return rows.where(good | F.col(score).isNull() if keep_null else good)


def with_misses(rows: DataFrame, inputs: DataFrame, key: str = "input") -> DataFrame:
    """rows, and a row of nulls for each input without any."""
    return inputs.select(key).distinct().join(rows, key, "left")


def by_input(rows: DataFrame, keep: Column, key: str = "input", drop: bool = False) -> DataFrame:
    """All rows of the inputs of which some row satisfies the condition, or of all other inputs."""
    hit = rows.where(keep).select(key).distinct()
    return rows.join(hit, key, "left_anti" if drop else "left_semi")


def joined_values(rows: DataFrame, key: Sequence[str], columns: Sequence[str], separator: str = ", ") -> DataFrame:
    """One row per key: distinct values in order, joined."""
    return rows.groupBy(*key).agg(*[F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), separator).alias(c) for c in columns])


def saved_to(table: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table's rows with the outputs found for their key beside them; keys meet whatever their case."""
    found = joined_values(rows.withColumn("_key", F.upper("input")), ["_key"], columns)
    return table.withColumn("_key", F.upper(key)).join(found, "_key", "left").drop("_key")


def collapsed_ranks(rows: DataFrame, how: str = "best") -> DataFrame:
    """target, rank, sources: many ranks on one target as the best, or as their mean."""
    value = F.min("rank").cast("double") if how == "best" else F.avg("rank")
    return rows.groupBy("target").agg(value.alias("rank"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"))


def grid(rows: DataFrame, row: str, column: str, columns: Sequence[str], score: str = "score") -> DataFrame:
    """The top score of each row and column, a column for each name given."""
    return rows.groupBy(row).pivot(column, list(columns)).agg(F.max(score))


def sparse_matrix(rows: DataFrame, row: str, column: str, score: str = "score") -> DataFrame:
    """i, j, value with the names numbered from 1 in order."""

    def axis(c: str, n: str) -> DataFrame:
        return numbered(rows.select(c).distinct(), [], [F.col(c).asc()], n)

    cells = rows.groupBy(row, column).agg(F.max(score).alias("value"))
    return cells.join(axis(row, "i"), row).join(axis(column, "j"), column).select("i", "j", "value")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def merged_results(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, score, sources: the top score of both, with all sources that have it."""
    both = keep_best(a.unionByName(b), [key])
    return both.groupBy(key).agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"))


def membership(rows: DataFrame, sets: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows (term) with, for each named set of (set_name, term, score), its score: -1 if unscored, null if not in it."""
    score = F.max(F.coalesce("score", F.lit(-1.0)))
    return rows.join(sets.groupBy("term").pivot("set_name", list(names)).agg(score), "term", "left")


def moments(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, cv of the numbers among the values, and the distinct others."""
    x = F.col(value).try_cast("double")
    out = rows.groupBy(*key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sort_array(F.collect_set(F.when(x.isNull(), F.col(value)))).alias("others"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")))


def has_all_words(text: Column, wanted: str) -> Column:
    return reduce(Column.__and__, [F.contains(F.lower(text), F.lit(w)) for w in wanted.lower().split()], F.lit(True))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, change: added, retired or kept."""
    a, b = old.select(*key).distinct().withColumn("_o", F.lit(1)), new.select(*key).distinct().withColumn("_n", F.lit(1))
    return a.join(b, list(key), "full_outer").select(*key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "retired").otherwise("kept").alias("change"))


def by_evidence(rows: DataFrame, *codes: str, column: str = "evidence") -> DataFrame:
    """Rows with one of these codes, and without those given as `!code`; a null code satisfies neither."""
    want, gone = [c for c in codes if not c.startswith("!")], [c[1:] for c in codes if c.startswith("!")]
    good = F.col(column).isin(*want) if want else F.col(column).isNotNull()
    return rows.where(good & ~F.col(column).isin(*gone) if gone else good)


_OPERATORS = {"=": operator.eq, "==": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def predicate(text: str) -> Column:
    """`[!]name op value` or `[!]name defined` as a condition; where the name is null it is false, with `!` too."""
    found = re.fullmatch(r"\s*(!?)\s*(\w+)\s*(?:(defined)|(==|>=|<=|=|>|<)\s*(.+?))\s*", text)
    if not found:
        raise ValueError(f"{text!r} is no condition")
    turned, name, defined, op, value = found.groups()
    column = F.col(name)
    if defined:
        return column.isNull() if turned else column.isNotNull()
    number = re.fullmatch(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?", value)
    fits = _OPERATORS[op](column.try_cast("double") if number else column.cast("string"), float(value) if number else value)
    return F.coalesce(~fits if turned else fits, F.lit(False))


def chosen_columns(rows: DataFrame, names: Sequence[str], aliases: dict[str, str] | None = None, prune: bool = False) -> DataFrame:
    """These columns in this order, under their own names or those that aliases stand for; with prune only those that hold anything."""
    real = [(aliases or {}).get(n, n) for n in names]
    if prune:
        full = rows.agg(*[F.count(F.col(c)).alias(f"c{k}") for k, c in enumerate(real)]).first()
        real = [c for c, n in zip(real, full, strict=True) if n]
    return rows.select(*[F.col(c) for c in real])


def by_threshold(rows: DataFrame, value: str, most: float, key: str) -> DataFrame:
    """key, kept, weak, unmeasured, best: how many rows of each key are at most so much, above it, or null, and the least value kept."""
    x = F.col(value)
    return rows.groupBy(key).agg(F.count_if(x <= most).alias("kept"), F.count_if(x > most).alias("weak"), F.count_if(x.isNull()).alias("unmeasured"), F.min(F.when(x <= most, x)).alias("best"))


def compared(rows: DataFrame, listed: DataFrame, key: str, term: str = "term", place: str = "place") -> DataFrame:
    """rows with `places`: the places at which a list (term, place) has their key, whatever its case, joined in order; null for none."""
    at = listed.groupBy(F.upper(term).alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(place)), lambda x: x.cast("string")), ",").alias("places"))
    return rows.withColumn("_key", F.upper(key)).join(at, "_key", "left").drop("_key")


def deep_membership(rows: DataFrame, sets: DataFrame, parents: DataFrame, names: Sequence[str]) -> DataFrame:
    """membership() in which a set also holds what the sets below it hold; parents: (child, parent) of set names."""
    above = closure(parents).select(F.col("node").alias("set_name"), F.col("ancestor").alias("_up"))
    lifted = sets.join(above, "set_name").select(F.col("_up").alias("set_name"), "term", "score")
    return membership(rows, sets.select("set_name", "term", "score").unionByName(lifted), names)


def best_terms(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """input, score, terms: the outputs that tie for an input's top score, without parents of others among them, joined in order."""
    best = leaves_only(keep_best(rows, ["input"]), parents)
    return best.groupBy("input").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set(F.col("output").cast("string"))), ", ").alias("terms"))


def rule_path(rules: DataFrame, source: str, target: str, most: int = 6) -> list[str]:
    """The spaces on the shortest way of rules (space_in, space_out) from one to another, the first by name among equals; empty if there is none.

    Rules are a vocabulary: pairs of spaces, of which each step keeps one way to each space.
    """
    ways = rules.sparkSession.createDataFrame([(source, [source])], "at string, way array<string>")
    step = rules.select(F.col("space_in").alias("at"), "space_out").distinct()
    for _ in range(most):
        there = ways.where(F.col("at") == target).select("way").first()
        if there:
            return list(there.way)
        further = ways.join(step, "at").where(~F.array_contains("way", F.col("space_out"))).select(F.col("space_out").alias("at"), F.concat("way", F.array("space_out")).alias("way"))
        ways = ways.unionByName(further).groupBy("at").agg(F.min_by("way", F.struct(F.size("way"), "way")).alias("way"))
    there = ways.where(F.col("at") == target).select("way").first()
    return list(there.way) if there else []


def allowed_conversions(rules: DataFrame, names: Sequence[str]) -> DataFrame:
    """space_in, and for each space the fewest rules that lead there, null for none: rules (space_in, space_out)."""
    reach = closure(rules.select(F.col("space_in").alias("child"), F.col("space_out").alias("parent")))
    return reach.groupBy(F.col("node").alias("space_in")).pivot("ancestor", list(names)).agg(F.min("depth"))


def converted(terms: DataFrame, rules: DataFrame, source: str, target: str) -> DataFrame:
    """input, output, score, via: terms (term) taken along the shortest way of rules (space_in, space_out, term_in, term_out, score)."""
    way = rule_path(rules, source, target)
    if len(way) < 2:
        return terms.sparkSession.createDataFrame([], "input string, output string, score double, via array<string>")
    steps = [rules.where((F.col("space_in") == a) & (F.col("space_out") == b)).select("term_in", "term_out", "score") for a, b in zip(way, way[1:], strict=False)]
    steps[0] = steps[0].join(terms.select(F.col("term").alias("term_in")).distinct(), "term_in", "left_semi")
    return chain(steps)


def best_ways(rules: DataFrame, source: str, target: str, k: int = 3, most: int = 6) -> list[list[str]]:
    """The k ways of rules (space_in, space_out, score) from one space to another by the most that they can score: the product of the best score of each step.

    Ways come to no space twice. Of equals the shorter counts, then the first by name. Rules are a
    vocabulary: pairs of spaces, of which each round keeps k ways to each space.
    """
    step = rules.where("space_in != space_out").groupBy(F.col("space_in").alias("at"), "space_out").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("weight"))
    ways = rules.sparkSession.createDataFrame([(source, [source], 1.0)], "at string, way array<string>, weight double")
    order = Window.partitionBy("at").orderBy(F.desc("weight"), F.size("way"), "way")
    done: list[tuple[float, int, list[str]]] = []
    for _ in range(most):
        further = ways.join(step.withColumnRenamed("weight", "_w"), "at").where(~F.array_contains("way", F.col("space_out")))
        further = further.select(F.col("space_out").alias("at"), F.concat("way", F.array("space_out")).alias("way"), (F.col("weight") * F.col("_w")).alias("weight"))
        ways = checkpointed(further.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
        done += [(-r.weight, len(r.way), list(r.way)) for r in ways.where(F.col("at") == target).collect()]
        ways = ways.where(F.col("at") != target)
        if ways.isEmpty():
            break
    return [way for _, _, way in sorted(done)[:k]]


def converted_best(terms: DataFrame, rules: DataFrame, source: str, target: str, k: int = 3, most: int = 6) -> DataFrame:
    """input, output, score, way, via: terms (term) taken along the k best ways of rules; for each input and output the best score, then the better way."""
    out = None
    for place, way in enumerate(best_ways(rules, source, target, k, most)):
        steps = [rules.where((F.col("space_in") == a) & (F.col("space_out") == b)).select("term_in", "term_out", "score") for a, b in zip(way, way[1:], strict=False)]
        steps[0] = steps[0].join(terms.select(F.col("term").alias("term_in")).distinct(), "term_in", "left_semi")
        rows = chain(steps).select("*", F.lit(place).alias("place"), F.array(*map(F.lit, way)).alias("way"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return terms.sparkSession.createDataFrame([], "input string, output string, score double, way array<string>, via array<string>")
    best = F.min_by(F.struct("score", "way", "via"), F.struct(-F.coalesce("score", F.lit(-1.0)), "place"))
    return out.groupBy("input", "output").agg(best.alias("b")).select("input", "output", "b.score", "b.way", "b.via")


def first_tags(meta: DataFrame, key: Sequence[str], tag: str = "tag", value: str = "value") -> DataFrame:
    """key, tag, value, n: one value for each tag of an edge, the first in order, and how many different ones there are."""
    return meta.groupBy(*key, tag).agg(F.min(value).alias(value), F.count_distinct(value).alias("n"))


def shuffled(rows: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """rows with `place`: their number in a random order that a seed and these columns fix."""
    keyed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))
    return numbered(keyed, [], [F.col("_h").asc()], "place").drop("_h")


def with_columns_of(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """rows with the columns that each table (key and others, one row for each key) has for them."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, rows)


def activities(measured: DataFrame, units: DataFrame, endpoints: DataFrame) -> DataFrame:
    """measured (endpoint, unit, value and others) with `standard` (the value in the base unit), `base` and `why` it is refused, or null.

    units: unit, base, factor; endpoints: endpoint and a base unit that it may have, one row for each.
    Refused are rows without a value, with a value that is no positive number, with an unknown
    endpoint or unit, and with a unit that the endpoint may not have. Names count whatever their case.
    """
    known = F.broadcast(units.select(F.upper("unit").alias("_u"), F.col("base").alias("_base"), F.col("factor").alias("_factor")).dropDuplicates(["_u"]))  # a vocabulary
    allowed = F.broadcast(endpoints.select(F.upper("endpoint").alias("_e"), F.col("base").alias("_ok")).distinct().groupBy("_e").agg(F.collect_set("_ok").alias("_bases")))
    rows = measured.withColumn("_u", F.upper("unit")).withColumn("_e", F.upper("endpoint")).join(known, "_u", "left").join(allowed, "_e", "left")
    number = F.col("value").try_cast("double") if dict(measured.dtypes)["value"] == "string" else F.col("value").cast("double")
    why = (
        F.when(F.col("value").isNull(), "no value").when(F.coalesce(number, F.lit(-1.0)).isin(float("inf")) | F.isnan(F.coalesce(number, F.lit(0.0))) | (F.coalesce(number, F.lit(-1.0)) <= 0), "no positive number")
        .when(F.col("_bases").isNull(), "unknown endpoint").when(F.col("_base").isNull(), "unknown unit").when(~F.array_contains("_bases", F.col("_base")), "unit not allowed")
    )
    out = rows.withColumn("why", why).withColumn("standard", F.when(F.col("why").isNull(), number * F.col("_factor"))).withColumn("base", F.when(F.col("why").isNull(), F.col("_base")))
    return out.select(*measured.columns, "standard", "base", "why")


def pivot_report(rows: DataFrame, target: str, item: str, kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """target, a column for each kind with its best value, n rows, and mean_of_best: the mean over items of their best."""
    best = rows.groupBy(target).pivot(kind, list(kinds)).agg(F.max(value))
    counts = rows.where(F.col(kind).isin(*kinds)).groupBy(target).agg(F.count("*").alias("n"))
    means = rows.groupBy(target, item).agg(F.max(value).alias("_b")).groupBy(target).agg(F.round(F.avg("_b"), 6).alias("mean_of_best"))
    return best.join(counts, target).join(means, target)


def custom_sets(rows: DataFrame, sets: DataFrame, key: str, names: dict[str, bool]) -> DataFrame:
    """rows with a column for each named set (set_name, term, note): whether it holds them; where the name says so, also `name_note` with the first note in order."""
    for name, noted in names.items():
        mine = sets.where(F.col("set_name") == name).groupBy(F.col("term").alias(key)).agg(F.min("note").alias("_note"), F.lit(True).alias("_in"))
        rows = rows.join(mine, key, "left").withColumn(name, F.coalesce("_in", F.lit(False)))
        rows = (rows.withColumn(f"{name}_note", F.col("_note")) if noted else rows).drop("_in", "_note")
    return rows
