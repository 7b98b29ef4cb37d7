"""Secrets in texts, judged by who else has them: corpus-wide frequencies of candidate values by repository and owner.

Patterns find candidates in every whole text; their values become digests in the same step, so no
table holds a raw secret. For each digest the distinct repositories (documents) and owners (sources)
of the whole corpus are counted. A value that many owners hold is a copied example; one that stays
with its owner, and looks generated, is live. Candidates of the base kinds (`assign`, `access`,
`hex`) are always reported; runs that look like keys of no known form (`blob`) only where they are
live, which is what the frequencies add.

DataFrame functions only. Texts are scanned once; what is shuffled are candidates. A value that more
than one candidate in 4,096 has (there are fewer than 4,096 of these) meets its verdict by a
broadcast, all others by a join.

Null and empty texts have no spans. Very long texts are scanned whole; the candidates of one text
meet in one task. A null doc_id is a repository of its own and a null source an owner of its own.
Rows that repeat a doc_id are judged each for itself and count as one repository; equal rows give
equal results. An empty table gives an empty result. Columns other than doc_id, text and source (or
those named instead) are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.shared import met_by_count

from .common import written


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case, the same for every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KINDS = ("assign", "access", "hex", "blob")
BASE = KINDS[:3]
_KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: Leftmost matches that do not overlap. For access and hex the least length is part of the pattern: a
#: shorter run holds no longer one. For assign it is not, since a short value hides keywords in it.
PATTERNS = {
    "assign": rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "blob": r"[A-Za-z0-9+/_-]{24,}={0,2}",
}
LEAST_VALUE = 12
#: Parts of values that stand for a secret.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "xxxx", "redacted", "12345678", "abcdefgh")


def looks_generated(value: Column) -> Column:
    """Whether a value has 16 characters, 8 different ones, a letter and a digit, and nothing of a placeholder."""
    plain = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.length(value) >= 16) & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & plain.rlike("[a-z]") & plain.rlike("[0-9]") & ~plain.rlike("|".join(PLACEHOLDERS))


def _hits(text: Column, kind: str) -> Column:
    """gap before, length, digest and looks of each match, in order; the last one is only the gap behind all."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))

    def measured(x: Column) -> Column:
        fits = F.length(x["value"]) >= LEAST_VALUE if kind == "assign" else F.lit(True)
        cases = x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") if kind == "blob" else F.lit(True)
        return F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n"), F.md5(x["value"]).alias("digest"), fits.alias("fits"), (cases & looks_generated(x["value"])).alias("looks"))

    return F.when(text.rlike(pattern), F.transform(zipped, measured))


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): row and repository for each document, and row, repository, owner, kind (its number), start, stop, digest, looks for each candidate."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[repository].alias("repository"), docs[owner].alias("owner"), F.coalesce(docs[text], F.lit("")).alias("text"))
    scanned = written(source.select("row", "repository", "owner", *[_hits(F.col("text"), k).alias(k) for k in KINDS]))  # ids of rows hold from here on
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(name).alias("hits")) for k, name in enumerate(KINDS)])
    some = " OR ".join(f"{name} IS NOT NULL" for name in KINDS)
    by_kind = scanned.where(some).select("row", "repository", "owner", F.explode(each).alias("_k")).where("_k.hits IS NOT NULL")
    hits = by_kind.select("row", "repository", "owner", "_k.kind", F.posexplode("_k.hits").alias("place", "hit")).where("hit.n IS NOT NULL").select("*", "hit.*").drop("hit")
    upto = Window.partitionBy("row", "kind").orderBy("place")
    placed = hits.withColumn("stop", F.sum((F.col("gap") + F.col("n")).cast("long")).over(upto)).withColumn("start", F.col("stop") - F.col("n"))
    return scanned.select("row", "repository"), written(placed.where("fits").select("row", "repository", "owner", "kind", "start", "stop", "digest", "looks"))


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_seen, n_owners, n_repositories over the whole corpus; a null is an owner or repository of its own."""
    some = F.lit(0)  # in a struct with it, a null counts as a value
    return found.groupBy("digest").agg(F.count("*").alias("n_seen"), F.countDistinct(F.struct(some, "owner")).alias("n_owners"), F.countDistinct(F.struct(some, "repository")).alias("n_repositories"))


def verdict(least_owners: int, least_repositories: int) -> Column:
    """`copied` where so many owners have the value, or two with so many repositories; else `live` if it looks generated, else `weak`."""
    copied = (F.col("n_owners") >= least_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= least_repositories))
    return F.when(copied, "copied").when(F.col("looks"), "live").otherwise("weak")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", *, least_owners: int = 3, least_repositories: int = 10) -> DataFrame:
    """repository and spans of every document, in the order of start and kind.

    A span has start, kind (its number in KINDS), stop (code points, exclusive), name, base, verdict,
    digest (md5 of the value), n_owners and n_repositories.
    """
    rows, found = candidates(docs, repository, owner, text)
    total = found.count()
    judged = met_by_count(found, ownership(found), ["digest"], "n_seen", total).withColumn("verdict", verdict(least_owners, least_repositories))
    base = F.col("kind") < len(BASE)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", "stop", name.alias("name"), base.alias("base"), "verdict", "digest", "n_owners", "n_repositories")
    spans = judged.where(base | (F.col("verdict") == "live")).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "row", "left").select("repository", F.coalesce("spans", none).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")
