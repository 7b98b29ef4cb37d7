"""From raw documents to a training mix: quality rules, near copies, repeated passages, test items, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
folder that the executors share and reads it again, so that a lost executor costs one stage at most;
what a stage leaves there besides, and the stage before it, are removed once it is written. All
stages but the last return the columns of documents.

Null, empty and blank texts go in the first stage, with all others of fewer than 50 words; a null
doc_id or source stays as it is (a null source is one of its own, the last). Rows that repeat a
doc_id are documents of their own if their texts differ; of equal texts, and of near copies, the
least doc_id stays. Very long texts are held whole by one task, never cut. Empty tables give empty
results. Columns beyond those of documents are handed on whatever their names, dots and the names
that operators use inside included; only the last stage's own four columns (size, source_size,
target, taken) take the place of such columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, jaccard_join, mixing, quality_ledger, substring_dedup
from weftgraph.llm.common import table
from weftgraph.plans.shared import located, shared_folder, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_ledger.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document has are cut."""
    return substring_dedup.dedup_documents(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single matches are cut from the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes from each."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("source_weights", source_weights),
]
#: SQL cannot cut spans out of raw texts or follow links of near copies at this size; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # nothing reads the stage before the last any more
            at, fs = located(spark, before)
            fs.delete(at, True)
        before = path
    return docs
