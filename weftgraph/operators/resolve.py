"""Statistics and matching: enrichment, fuzzy names, reciprocal best pairs, orthologue collapse."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftgraph.functions.text import words
from weftgraph.operators.stretches import numbered
from weftgraph.plans.shared import checkpointed, met, met_by_count

#: Coefficients of Stirling's series for the logarithm of the gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithms of n!, to about 1e-13 of them."""
    x = np.asarray(n, float) + 1
    shift = np.zeros(len(x))
    for _ in range(10):  # the series needs x of 10 or more
        small = x < 10
        shift -= np.where(small, np.log(np.where(small, x, 1)), 0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + sum(c / x ** (2 * k + 1) for k, c in enumerate(_STIRLING))


def tails(k: np.ndarray, n: np.ndarray, size: np.ndarray, world: np.ndarray, under: np.ndarray) -> np.ndarray:
    """log10 of the chances of k or more (or fewer) of a term's `size` members among n drawn from the world; -999 for none.

    The first term comes from logarithms, the others from their ratios, all rows at a time, until they add nothing.
    """
    k, n, size, world = (np.asarray(x, float) for x in (k, n, size, world))
    low, high = np.maximum(0, n + size - world), np.minimum(size, n)
    at = np.where(under, np.minimum(k, high), np.maximum(k, low))
    good = (at >= low) & (at <= high)
    at = np.where(good, at, low)
    log = sum(log_factorial(x) for x in (size, world - size, n, world - n)) - log_factorial(world)
    log -= sum(log_factorial(x) for x in (at, size - at, n - at, world - size - n + at))
    total, term = np.ones(len(k)), np.ones(len(k))
    live = np.flatnonzero(good)
    while len(live):
        i, s, m, w = at[live], size[live], n[live], world[live]
        up = (s - i) * (m - i) / ((i + 1) * (w - s - m + i + 1))
        down = i * (w - s - m + i) / ((s - i + 1) * (m - i + 1))
        term[live] *= np.where(under[live], down, up)
        total[live] += term[live]
        at[live] += np.where(under[live], -1, 1)
        live = live[(term[live] > 1e-17 * total[live]) & (at[live] >= low[live]) & (at[live] <= high[live])]
    return np.where(good, (log + np.log(total)) / math.log(10), -999.0)


@F.pandas_udf(DoubleType())
def log10_tail(k: pd.Series, n: pd.Series, size: pd.Series, world: pd.Series, under: pd.Series) -> pd.Series:
    return pd.Series(tails(*(x.to_numpy() for x in (k, n, size, world, under))))


def enrichment(terms: DataFrame, picked: DataFrame, least: float = 1e-180, most_share: float = 1.0) -> DataFrame:
    """term, size, hits, expected, log_p, log_p_all: terms (term, id) against picked ids, in the world of all ids with a term.

    Over-represented terms get the upper tail, under-represented ones the lower tail with its sign
    turned; log_p_all counts every term tested. Terms with more than `most_share` of the world are not
    tested; those rarer than `least` by chance are, but left out.
    """
    member = terms.select("term", "id").distinct()
    world = member.agg(F.count_distinct("id").alias("world"))
    drawn = member.join(picked.select("id").distinct(), "id", "left_semi")
    n = drawn.agg(F.count_distinct("id").alias("n"))
    sizes = member.groupBy("term").agg(F.count("*").alias("size")).join(drawn.groupBy("term").agg(F.count("*").alias("hits")), "term", "left").na.fill(0, ["hits"])
    rows = sizes.join(F.broadcast(world.join(F.broadcast(n))))  # one row
    rows = rows.where(F.col("size") <= most_share * F.col("world")).withColumn("expected", F.col("n") * F.col("size") / F.col("world"))
    under = F.col("hits") < F.col("expected")
    tests = F.broadcast(rows.agg(F.log10(F.count("*")).alias("tests")))
    rows = rows.withColumn("log_p", log10_tail("hits", "n", "size", "world", under)).where(F.col("log_p") >= math.log10(least))
    corrected = F.least(F.lit(0.0), F.col("log_p") + F.col("tests"))
    return rows.join(tests).select("term", "size", "hits", "expected", F.when(under, -F.col("log_p")).otherwise(F.col("log_p")).alias("log_p"), corrected.alias("log_p_all"))


def enrichment_of_lists(terms: DataFrame, lists: DataFrame, least: float = 1e-180, most_share: float = 1.0, whole: float = 0.5) -> DataFrame:
    """list, term, mode, size, hits, log_p, log_p_terms, log_p_lists, es: terms (term, id) against every list (list, id, rank) at once.

    A list with less than `whole` of the world is `picked`: its terms get tails as in enrichment(),
    corrected for the terms tested in it and then for the number of such lists. A list with more is
    `ranked`: picking says nothing there, so its terms get the running sum over its ranks. Each list and
    term is a row of one aggregation; nothing loops over lists.
    """
    member = terms.select("term", "id").distinct()
    known = member.select("id").distinct()
    world = known.agg(F.count("*").alias("world"))
    drawn = checkpointed(lists.groupBy("list", "id").agg(F.min("rank").alias("rank")).join(known, "id", "left_semi"))
    sizes = drawn.groupBy("list").agg(F.count("*").alias("n")).join(F.broadcast(world)).withColumn("mode", F.when(F.col("n") >= whole * F.col("world"), "ranked").otherwise("picked"))
    sizes = checkpointed(sizes)
    picked = sizes.where("mode = 'picked'")
    hits = drawn.join(picked, "list").join(member, "id").groupBy("list", "term").agg(F.count("*").alias("hits"))
    of_terms = member.groupBy("term").agg(F.count("*").alias("size")).join(F.broadcast(world)).where(F.col("size") <= most_share * F.col("world")).drop("world")
    tested = of_terms.agg(F.log10(F.greatest(F.count("*"), F.lit(1))).alias("_terms"))
    n_lists = picked.agg(F.log10(F.greatest(F.count("*"), F.lit(1))).alias("_lists"))
    rows = hits.join(of_terms, "term").join(picked, "list")
    under = F.col("hits") < F.col("n") * F.col("size") / F.col("world")
    rows = rows.withColumn("log_p", log10_tail("hits", "n", "size", "world", under)).where(F.col("log_p") >= math.log10(least)).join(F.broadcast(tested)).join(F.broadcast(n_lists))
    by_terms = F.least(F.lit(0.0), F.col("log_p") + F.col("_terms"))
    nothing = F.lit(None).cast("double")
    out = rows.select("list", "term", "mode", "size", "hits", F.when(under, -F.col("log_p")).otherwise(F.col("log_p")).alias("log_p"), by_terms.alias("log_p_terms"), F.least(F.lit(0.0), by_terms + F.col("_lists")).alias("log_p_lists"), nothing.alias("es"))
    ranked = numbered(drawn.join(sizes.where("mode = 'ranked'").select("list"), "list", "left_semi"), ["list"], [F.col("rank").asc(), F.col("id").asc()], "_place", ties=False)
    steps = checkpointed(numbered(ranked.join(member, "id").select("list", "term", F.col("_place").alias("rank")), ["list", "term"], [F.col("rank").asc()], "i", ties=False))
    steps = steps.join(steps.groupBy("list", "term").agg(F.count("*").alias("hits")), ["list", "term"]).join(sizes.select("list", "n"), "list")
    high, low = _deviations(F.col("i"), F.col("hits"), F.col("rank"), F.col("n"))
    sums = steps.groupBy("list", "term").agg(F.max(high).alias("high"), F.min(low).alias("low"), F.max("hits").alias("hits")).join(of_terms, "term")
    es = F.round(F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")), 9)
    return out.unionByName(sums.select("list", "term", F.lit("ranked").alias("mode"), "size", "hits", *[nothing.alias(c) for c in ("log_p", "log_p_terms", "log_p_lists")], es.alias("es")))


def _deviations(i: Column, size: Column, rank: Column, total: Column) -> tuple[Column, Column]:
    """The running sum after and before a term's i-th member, at this rank."""
    others = F.greatest(total - size, F.lit(1))
    return i / size - (rank - i) / others, (i - 1) / size - (rank - i) / others


def word_hits(texts: DataFrame, least_length: int = 2) -> DataFrame:
    """id, source, word, score: the words of (id, source, text); a word's score is its share of the text's words."""
    rows = texts.select("id", "source", words(F.col("text")).alias("ws"))
    return rows.select("id", "source", F.explode("ws").alias("word"), (1.0 / F.size("ws")).alias("score")).where(F.length("word") >= least_length)


def blacklist(hits: DataFrame, share: float) -> DataFrame:
    """source, word, freq: words that more than this share of a source's ids have."""
    ids = hits.groupBy("source").agg(F.count_distinct("id").alias("ids"))
    counts = checkpointed(hits.groupBy("source", "word").agg(F.count_distinct("id").alias("n")))
    return met(counts, ids, "source").select("source", "word", (F.col("n") / F.col("ids")).alias("freq")).where(F.col("freq") > share)


def resolve(queries: DataFrame, hits: DataFrame, black: DataFrame, top: int = 3) -> DataFrame:
    """query_id, id, score: ids by the summed best score of the query's words, times the share of the words they have.

    Blacklisted words find no ids, but count for ids that other words have found. Ties go to the lower id.
    """
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("word"))
    total = asked.groupBy("query_id").agg(F.count("*").alias("total"))
    best = hits.groupBy("id", "source", "word").agg(F.max("score").alias("score"))
    good = best.join(black, ["source", "word"], "left_anti").groupBy("id", "word").agg(F.max("score").alias("score"))
    found = asked.join(good, "word").select("query_id", "id", "word", "score")
    common = best.join(black, ["source", "word"], "left_semi").groupBy("id", "word").agg(F.max("score").alias("score"))
    ids = found.select("query_id", "id").distinct().join(common, "id")
    again = ids.join(asked, ["query_id", "word"]).select("query_id", "id", "word", "score").join(found.select("query_id", "id", "word"), ["query_id", "id", "word"], "left_anti")
    scored = found.unionByName(again).groupBy("query_id", "id").agg(F.sum("score").alias("sum"), F.count("*").alias("n")).join(total, "query_id")
    scored = scored.select("query_id", "id", F.round(F.col("sum") * F.col("n") / F.col("total"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def reciprocal_best(pairs: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: pairs (a, b, identity, matched, similar) that are best both ways, with the sizes of the tied sets.

    The best of a are all b that tie on identity, matched and similar; ties are few. Sets count only if
    they are closed: each of them is the best set of every member of the other.
    """
    key = [F.desc("identity"), F.desc("matched"), F.desc("similar")]
    ranked = pairs.withColumn("ra", F.rank().over(Window.partitionBy("a").orderBy(*key))).withColumn("rb", F.rank().over(Window.partitionBy("b").orderBy(*key)))
    best_a = ranked.where("ra = 1").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("sa"))
    best_b = ranked.where("rb = 1").groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("sb"))
    mutual = ranked.where("ra = 1 AND rb = 1").select("a", "b").distinct().join(best_a, "a").join(best_b, "b")
    both = F.count("*").over(Window.partitionBy("sa", "sb"))
    closed = mutual.withColumn("n", both).where(F.col("n") == F.size("sa") * F.size("sb"))
    return closed.select("a", "b", F.size("sa").alias("n_a"), F.size("sb").alias("n_b"))


def collapsed_orthologues(pairs: DataFrame) -> DataFrame:
    """gene, parent, weight: each gene with its best-weighted parent in the species, and each parent with its best gene."""
    order = Window.partitionBy("gene", "species").orderBy(F.desc("weight"), "parent")
    first = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    back = Window.partitionBy("parent").orderBy(F.desc("weight"), "gene")
    return first.withColumn("_n", F.row_number().over(back)).where("_n = 1").select("gene", "species", "parent", "weight")


def running_enrichment(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """term, es: the largest deviation of the running sum over a ranked list (id, rank), up for members and down for others.

    The sum needs no pass over the list in one task: before a term's i-th member, at rank r, it has
    met i - 1 members and r - i others, so only the members' own ranks matter. These are numbered by
    stretches, so that a term which holds most of the list fills no task.
    """
    total = F.broadcast(ranked.agg(F.count("*").alias("total")))
    hits = checkpointed(numbered(members.join(ranked, "id").select("term", "rank"), ["term"], [F.col("rank").asc()], "i", ties=False))
    steps = met_by_count(hits, hits.groupBy("term").agg(F.count("*").alias("size")), ["term"], "size", hits.count()).join(total)
    high, low = _deviations(F.col("i"), F.col("size"), F.col("rank"), F.col("total"))
    sides = steps.groupBy("term").agg(F.max(high).alias("high"), F.min(low).alias("low"), F.max("size").alias("size"))
    return sides.select("term", "size", F.round(F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")), 9).alias("es"))
