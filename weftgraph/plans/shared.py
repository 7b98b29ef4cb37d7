"""The folder that driver and executors share, lineage cut there, and joins on keys of very unlike sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the context was given; a folder of one machine would lose data, so none is made up.

    Only a local session, whose executors are threads of the driver, gets a folder under its warehouse.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return folder.rstrip("/")


def located(spark: SparkSession, path: str):
    """(path, file system) of Hadoop, which is what Spark reads and writes through."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    at, fs = located(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def heeding_case(spark: SparkSession) -> SparkSession:
    """A session of the same application with the same settings, in which names of columns that differ by case alone are two: for tables that have such columns, which no other session writes."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.caseSensitive", "true")
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Tables made within each temporary() that is open.
_MADE: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that written() makes inside, at its end: for work whose result is stored elsewhere by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            at, fs = located(spark, path)
            fs.delete(at, True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which is smaller than a checkpoint of many rows and takes one run of the plan, not two; in a folder for each value of some columns, if they are named."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that more than this share of all rows have is hot; so there are fewer hot keys than this.
HOT = 4096


def met_by_count(rows: DataFrame, other: DataFrame, keys: Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with other, which has one row for each key and, in `count`, how many of the rows have it; total is their sum.

    The fewer than 4,096 keys that more than one row in 4,096 has meet their rows by a broadcast, all
    others in a join on the key, where none can fill a task; rows without a key take part in neither.
    rows are read twice.
    """
    hot, keyless = F.col(count) * HOT > total, " OR ".join(f"{k} IS NULL" for k in keys)
    near = rows.join(F.broadcast(other.where(hot).withColumn("_hot", F.lit(True))), list(keys), "left")
    far = near.where(f"_hot IS NULL AND NOT ({keyless})").select(*[f"`{c}`" for c in rows.columns]).join(other.where(~hot), list(keys), how)
    done = near.where("_hot" if how == "inner" else f"_hot OR {keyless}")
    return done.drop("_hot").unionByName(far)


def met(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """met_by_count() with the counts measured: rows joined with other, which has one row for each key, whatever share of the rows a key has."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return met_by_count(rows, other.join(counts, key), [key], "_n", rows.count(), how).drop("_n")
