"""Ranks, running values and neighbours in orders of any length, stretch by stretch.

A table is dealt to stretches of its order by ranges; windows work within a stretch, and what the
stretches before add is taken from one row for each of them. So no task receives a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.shared import written

CHUNK = "_stretch"


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with the number of their stretch in the order of by and order; rows that tie are in one stretch."""
    return written(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(CHUNK, F.spark_partition_id()))


def _with_before(rows: DataFrame, by: Sequence[str], value: Column, over: str) -> DataFrame:
    """rows with `_before`: the sum, max or last of the values of the earlier stretches of their group; null without any."""
    per = rows.groupBy(*by, CHUNK).agg(value.alias("_v"))
    w = Window.partitionBy(*by).orderBy(CHUNK)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    before = {"sum": F.sum("_v").over(earlier), "max": F.max("_v").over(earlier), "last": F.lag("_v").over(w)}[over]
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(CHUNK).alias("_at"), before.alias("_before"))
    same = F.col(CHUNK) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(per, same).drop("_at", *[f"_by_{c}" for c in by])


def _inside(by: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*by, CHUNK).orderBy(*order)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", ties: bool = True) -> DataFrame:
    """rows with their rank (or, without ties, row number) within groups of any size."""
    dealt = _with_before(ranged(rows, by, order), by, F.count("*"), "sum")
    place = (F.rank() if ties else F.row_number()).over(_inside(by, order))
    return dealt.withColumn(name, (F.coalesce("_before", F.lit(0)) + place).cast("long")).drop("_before", CHUNK)


def running(dealt: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str, over: str = "sum", current: bool = True) -> DataFrame:
    """ranged() rows with the sum or max of a value up to each row, or up to the one before."""
    fn = F.sum if over == "sum" else F.max
    dealt = _with_before(dealt, by, fn(value), over)
    here = fn(value).over(_inside(by, order).rowsBetween(Window.unboundedPreceding, 0 if current else -1))
    both = F.coalesce(F.col("_before") + here, "_before", here) if over == "sum" else F.greatest("_before", here)
    return dealt.withColumn(name, both).drop("_before")


def reached(dealt: DataFrame, by: Sequence[str], order: Sequence[Column], count: Column, last: Column, names: tuple[str, str]) -> DataFrame:
    """ranged() rows with the sum of a count and the max of another value up to each row, in one pass."""
    per = dealt.groupBy(*by, CHUNK).agg(F.sum(count).alias("_s"), F.max(last).alias("_m"))
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(CHUNK).alias("_at"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sums"), F.max("_m").over(earlier).alias("_lasts"))
    same = F.col(CHUNK) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = _inside(by, order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({"_s": F.coalesce(F.sum(count).over(here), F.lit(0)), "_m": F.max(last).over(here)}).join(per, same)
    return dealt.withColumns({names[0]: F.col("_sums") + F.col("_s"), names[1]: F.greatest("_lasts", "_m")}).drop("_at", "_s", "_m", "_sums", "_lasts", *[f"_by_{c}" for c in by])


def previous(dealt: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """ranged() rows with a value of the row before."""
    w = _inside(by, order)
    dealt = dealt.withColumn("_value", value)
    last = dealt.withColumn("_next", F.lead(F.lit(True)).over(w)).where("_next IS NULL").select(*by, CHUNK, "_value")
    per = last.withColumn("_v", F.lag("_value").over(Window.partitionBy(*by).orderBy(CHUNK)))
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(CHUNK).alias("_at"), F.col("_v").alias("_before"))
    same = F.col(CHUNK) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = F.lag("_value").over(w)
    first = F.row_number().over(w) == 1
    return dealt.join(per, same).withColumn(name, F.when(first, F.col("_before")).otherwise(here)).drop("_at", "_before", "_value", *[f"_by_{c}" for c in by])
