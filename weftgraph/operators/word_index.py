"""A stored inverted index of words, for resolving names without reading the texts again.

Each taxon's hits lie in folders of their own, by bucket of the word's hash, with a flag for words
that too many of a source's ids have. load() replaces one taxon and leaves the others; resolve()
reads only the buckets of the words that are asked. A word with more than one hit in 4,096 (fewer
than 4,096 such) is dealt to several files by id, so that no task writes or reads all of its hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import words
from weftgraph.operators import resolve as R
from weftgraph.plans.shared import HOT, checkpointed, listed, located, written

_DEAL = 64
_HITS = "id long, source string, word string, score double, black boolean"


@dataclass(frozen=True)
class WordIndex:
    spark: SparkSession
    folder: str
    buckets: int = 64
    share: float = 0.12  # of a source's ids, from which a word is on its blacklist

    def _bucket(self):
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def taxa(self) -> dict[str, int]:
        """The version of each taxon that was written whole last."""
        out = {}
        for name in listed(self.spark, self.folder):
            have = [int(v[2:]) for v in listed(self.spark, f"{self.folder}/{name}") if v.startswith("v=") and "_SUCCESS" in listed(self.spark, f"{self.folder}/{name}/{v}")]
            if name.startswith("taxon=") and have:
                out[name[6:]] = max(have)
        return out

    def load(self, taxon: str | int, texts: DataFrame) -> int:
        """Makes the hits of (id, source, text) the taxon's own, in place of those it had; returns the version."""
        hits = R.word_hits(texts).groupBy("id", "source", "word").agg(F.max("score").alias("score"))
        hits = written(hits)
        black = R.blacklist(hits, self.share).select("source", "word", F.lit(True).alias("black"))
        counts = hits.groupBy("word").agg(F.count("*").alias("n"))
        hot = F.broadcast(counts.where(F.col("n") * HOT > hits.count()).select("word", F.lit(True).alias("hot")))
        rows = hits.join(black, ["source", "word"], "left").join(hot, "word", "left")
        rows = rows.select("id", "source", "word", "score", F.coalesce("black", F.lit(False)).alias("black"), self._bucket().alias("bucket"), F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(_DEAL))).otherwise(0).alias("deal"))
        version = self.taxa().get(str(taxon), 0) + 1
        rows.repartition("bucket", "deal").drop("deal").write.partitionBy("bucket").parquet(f"{self.folder}/taxon={taxon}/v={version}")
        return version

    def hits(self, asked: DataFrame, taxa: Sequence[str | int] | None = None) -> DataFrame:
        """taxon and hits in the buckets of the words in asked (word), of some taxa or all."""
        wanted = [r.b for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        have = self.taxa()
        paths = []
        for taxon in sorted(have) if taxa is None else [t for t in map(str, taxa) if t in have]:
            path = f"{self.folder}/taxon={taxon}/v={have[taxon]}"
            there = set(listed(self.spark, path))
            paths += [f"{path}/bucket={b}" for b in wanted if f"bucket={b}" in there]
        if not paths:
            return self.spark.createDataFrame([], f"taxon string, {_HITS}")
        return self.spark.read.schema(f"{_HITS}, taxon string, v int, bucket int").option("basePath", self.folder).parquet(*paths).select("taxon", *[c.split()[0] for c in _HITS.split(", ")])

    def resolve(self, queries: DataFrame, taxa: Sequence[str | int] | None = None, top: int = 3) -> DataFrame:
        """query_id, id, score: as resolve.resolve() finds them in the texts that were loaded."""
        asked = queries.select(F.explode(words(F.col("text"))).alias("word")).distinct()
        hits = checkpointed(self.hits(asked, taxa).join(asked, "word", "left_semi"))
        return R.resolve(queries, hits.select("id", "source", "word", "score"), hits.where("black").select("source", "word").distinct(), top)

    def standardised(self, queries: DataFrame, taxa: Sequence[str | int] | None = None, top: int = 3) -> DataFrame:
        """query_id, best (the id, null for none), sure (whether no other has its score) and others as JSON, for every query."""
        found = self.resolve(queries, taxa, top)
        order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id")))  # `top` at most
        per = found.groupBy("query_id").agg(order.alias("r"))
        sure = (F.size("r") == 1) | (F.get("r", F.lit(1))["less"] > F.get("r", F.lit(0))["less"])
        others = F.to_json(F.transform(F.slice("r", 2, top), lambda x: F.struct(x["id"].alias("id"), (-x["less"]).alias("score"))))
        return queries.select("query_id").distinct().join(per.select("query_id", F.get("r", F.lit(0))["id"].alias("best"), sure.alias("sure"), others.alias("others")), "query_id", "left")

    def drop(self, taxon: str | int, keep: int = 0) -> None:
        """Removes all but the last `keep` versions of a taxon."""
        names = sorted((n for n in listed(self.spark, f"{self.folder}/taxon={taxon}") if n.startswith("v=")), key=lambda n: int(n[2:]))
        for n in names[: len(names) - keep]:
            at, fs = located(self.spark, f"{self.folder}/taxon={taxon}/{n}")
            fs.delete(at, True)

