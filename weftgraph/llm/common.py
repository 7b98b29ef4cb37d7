"""Small helpers that the operators share: words, hashes, Arrow batches, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from weftgraph.plans.shared import checkpointed, shared_folder, written  # noqa: F401  the operators take these from here

#: A word is a run of characters other than these; `bytes.split()` splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: The id that rows without a doc_id are ordered and joined under.
NO_ID = -(2**63)
_HELD_WORDS = 1 << 17


def split_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n items, from the items' hashes, by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have, power, at = None, 0, h, 1
    while True:
        if n & at:
            if out is None:
                out, have = power, at
            else:
                m = min(len(out), len(power) - have)
                out, have = mix(out[:m] * _ODD + power[have : have + m]), have + at
        if have == n:
            return out[: len(h) - n + 1]
        power = mix(power[:-at] * _ODD + power[at:] * np.uint64(3))
        at *= 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def carried(kinds: dict[str, DataType], more: str) -> StructType:
    """A schema of columns with these types, whatever field names they hold, and of what the DDL text says."""
    return StructType([StructField(n, k) for n, k in kinds.items()] + StructType.fromDDL(more).fields)


def in_small_batches(spark: SparkSession) -> None:
    """Python workers get at most 8 MB at a time, unless the session has a bound of its own: whole texts make large batches, which JVM and worker hold several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):  # Spark's own
        spark.conf.set(key, str(8 << 20))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    in_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(arrow, (columns[f.name] for f in arrow), strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def lists(flat: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """A list column from its values end to end and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sieve:
    """Which 64-bit hashes may be in a set: two bits for each, so that a no is always right.

    There are 16 to 32 bits for each hash in the set, of which under 1.4 in 100 others pass, and at
    most 2^29 of them (64 MB, the most that the driver sees and tasks hold); larger sets let more
    others through, and lose none.
    """

    def __init__(self, hashes: DataFrame):
        spark, (column,) = hashes.sparkSession, hashes.columns
        self.bits = min(29, max(15, (hashes.count() * 16).bit_length()))
        cells = F.array(*[F.shiftrightunsigned(column, k).bitwiseAND(F.lit((1 << self.bits) - 1)) for k in (0, 20)])
        dealt = hashes.select(F.explode(cells).alias("cell")).select(F.shiftright("cell", 15).cast("int").alias("place"), F.col("cell").bitwiseAND(F.lit(0x7FFF)).alias("bit")).repartition("place")
        held = np.zeros((1 << self.bits) // 8, np.uint8)
        for place, part in dealt.groupBy("place").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
            held[place << 12 : (place + 1) << 12] = np.frombuffer(part, np.uint8)
        self.cells = spark.sparkContext.broadcast(held)
        in_small_batches(spark)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        held, out = self.cells.value, np.ones(len(hashes), bool)
        for k in (0, 20):
            cell = (hashes.view(np.uint64) >> np.uint64(k)) & np.uint64((1 << self.bits) - 1)
            out &= (held[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out

    def column(self, hashes: Column) -> Column:
        def look(h: pd.Series) -> pd.Series:
            return pd.Series(self.may_hold(h.to_numpy(np.int64)))

        return F.pandas_udf(look, "boolean")(hashes)


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The rows of counts (a key, n) down to the lowest level of n that at most so many rows reach, the largest n first.

    Levels are 32 to a doubling, at most 2,017 of them, so no task and not the driver sees more rows than asked for.
    """
    level = F.floor(32 * F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)
    levels = sizes["level"][sizes["count"].cumsum() <= most]
    least = int(levels.min()) if len(levels) else 1 << 30
    key = next(c for c in counts.columns if c != "n")
    return counts.where(level >= least).toPandas().sort_values(["n", key], ascending=[False, True])


def keyed(docs: DataFrame, key: str = "doc_id") -> Column:
    return F.coalesce(docs[key].cast("long"), F.lit(NO_ID))


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def parts_of(row: str, columns: list[str], **new: Column) -> list[Column]:
    """The columns of such a struct, with some replaced."""
    return [(new[c] if c in new else F.col(row).getField(c)).alias(c) for c in columns]
