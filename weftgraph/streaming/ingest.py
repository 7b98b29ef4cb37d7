"""Set and kill operations on edges: batch folds, versioned tables, and micro-batches of dropped files.

An operation sets or kills an edge for an authority at a time. Within one batch kills come before
sets, so that an edge both killed and set is live. An edge is live while any authority holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Schema of operation files.
OPERATIONS = "batch long, seq long, op string, name1 string, name2 string, type_id int, authority string, at timestamp"
_KEY = ["name1", "name2", "type_id"]


def folded(operations: DataFrame) -> DataFrame:
    """name1, name2, type_id, authority, live, size, dates: the last state by authority and when it changed.

    Only the last operation of each batch's kind counts, and a repeated state changes nothing.
    """
    one = operations.groupBy(*_KEY, "authority", "batch").agg(F.max(F.struct(F.col("op") == "set", "at")).alias("last"))
    steps = F.sort_array(F.collect_list(F.struct("batch", F.col("last.col1").alias("live"), F.col("last.at").alias("at"))))  # an edge has few batches
    rows = one.groupBy(*_KEY, "authority").agg(steps.alias("steps"))
    changes = F.filter("steps", lambda x, i: (i == 0) | (x["live"] != F.get("steps", i - 1)["live"]))
    rows = rows.withColumn("changes", changes)
    return rows.select(*_KEY, "authority", F.element_at("changes", -1)["live"].alias("live"), F.size("changes").alias("size"), F.transform("changes", lambda x: x["at"]).alias("dates"))


def edge_states(history: DataFrame) -> DataFrame:
    """name1, name2, type_id, live, authorities: an edge lives while one of its authorities does."""
    return history.groupBy(*_KEY).agg(F.bool_or("live").alias("live"), F.count_if("live").alias("authorities"))


def advanced(history: DataFrame, operations: DataFrame) -> DataFrame:
    """The history after one more batch."""
    now = folded(operations.withColumn("batch", F.lit(0).cast("long"))).select(*_KEY, "authority", F.col("live").alias("_live"), F.col("dates")[0].alias("_at"))
    both = history.join(now, [*_KEY, "authority"], "full_outer")
    changed = F.col("_live").isNotNull() & (F.col("live").isNull() | (F.col("live") != F.col("_live")))
    return both.select(
        *_KEY, "authority", F.coalesce("_live", "live").alias("live"),
        (F.coalesce("size", F.lit(0)) + changed.cast("int")).alias("size"),
        F.when(changed, F.concat(F.coalesce("dates", F.array().cast("array<timestamp>")), F.array("_at"))).otherwise(F.col("dates")).alias("dates"),
    )


def without(table: DataFrame, killed: DataFrame, columns: list[str]) -> DataFrame:
    """The table's rows that no killed row matches on these columns; a null in a killed row matches anything."""
    fit = [(table[c].eqNullSafe(killed[c])) for c in columns]
    if killed.where(" OR ".join(f"{c} IS NULL" for c in columns)).isEmpty():
        cond = fit[0]
        for f in fit[1:]:
            cond = cond & f
        return table.join(killed, cond, "left_anti")
    out = table
    for given in [[c for k, c in enumerate(columns) if mask >> k & 1] for mask in range(1, 1 << len(columns))]:
        rest = [c for c in columns if c not in given]
        rows = killed.where(" AND ".join([f"{c} IS NOT NULL" for c in given] + [f"{c} IS NULL" for c in rest])).select(*given).distinct()
        out = out.join(rows, given, "left_anti")
    return out


def with_tags(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Edge metadata after changes (name1, name2, type_id, tag, value): a null value clears the tag, the tag `%` all of them.

    Values that read as numbers go to numeric_value, others to text_value.
    """
    cleared = changes.where("tag = '%'").select(*_KEY).distinct()
    named = changes.where("tag != '%'")
    kept = meta.join(cleared, _KEY, "left_anti").join(named.select(*_KEY, "tag").distinct(), [*_KEY, "tag"], "left_anti")
    number = F.col("value").try_cast("double")
    new = named.where("value IS NOT NULL").select(*_KEY, "tag", F.when(number.isNull(), F.col("value")).alias("text_value"), number.alias("numeric_value")).distinct()
    return kept.select(*new.columns).unionByName(new)


def write_version(df: DataFrame, folder: str) -> str:
    """Writes the next version of a table and only then points to it; readers keep the version they have."""
    spark = df.sparkSession
    version = current(spark, folder) + 1
    path = f"{folder.rstrip('/')}/v{version}"
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder.rstrip('/')}/_versions")
    return path


def current(spark: SparkSession, folder: str) -> int:
    """The last version that was written whole, or 0."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_versions")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.schema("version long").json(at.toString()).agg(F.max("version")).first()[0] or 0


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/v{version or current(spark, folder)}")


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Folds all operation files (JSON lines) dropped so far into the versioned history in `store`, then stops.

    A batch that is run again after a failure folds the same states and adds no dates.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        fresh = batch.dropDuplicates()
        session = batch.sparkSession
        history = advanced(read_version(session, store), fresh) if current(session, store) else folded(fresh.withColumn("batch", F.lit(0).cast("long")))
        write_version(history, store)

    stream = spark.readStream.schema(OPERATIONS).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(cached: DataFrame, now: str, days: int, redo_null: int | None = None) -> DataFrame:
    """Rows of a conversion cache that are older than so many days, or, if unscored, than the days for those."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col("updated"))
    limit = F.when(F.col("score").isNull(), F.lit(days if redo_null is None else redo_null)).otherwise(F.lit(days))
    return cached.where(age > limit)


def windowed(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """window_start, event_type, n: events per window, for tables and streams alike (an extension)."""
    events = events if late is None else events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """user_id, session_start, n: runs of a user's events with no gap of that length (an extension)."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
