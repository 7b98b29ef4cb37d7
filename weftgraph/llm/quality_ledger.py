"""Quality rules: every rule is evaluated once into a failure bit, policies are bit masks over the stored ledger.

Null, empty and blank texts have no words and fail the rule on short texts. Rows with a null or
repeated doc_id are judged one by one; an empty table gives an empty result. A very long text is
measured whole in one task, with about 100 bytes for each of its words. Other columns are passed
through whatever their names, but for those named like the ledger's own, which take their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, map_arrow, parts_of, split_words, whole

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


@dataclass(frozen=True)
class Rule:
    """A text fails when the SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Conditions in whole numbers, so that every engine decides alike.
RULES = (
    Rule(0, "short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "upper_case", "10 * n_upper > 7 * word_chars"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)
#: Version: names of the rules whose failure rejects a text.
POLICIES = {
    "base": ("short", "repeated_windows"),
    "v1": ("short", "repeated_windows", "symbols", "repeated_lines", "upper_case", "long_words"),
}


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << r.bit for r in rules if r.name in names)


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words within runs of n words that the text has more than once."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids
    for k in range(1, n):  # exact: each pair of ids gets an id of its own
        key = key[: len(words) - k] * len(words) + ids[k:]
        if k < n - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    again = np.flatnonzero(count[at] > 1)
    for k in range(n):
        hit[again + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    words = split_words(text)
    if not words:
        return (0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper = text.encode("utf-8", "surrogatepass").translate(None, bytes(set(range(256)) - set(range(65, 91))))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(upper))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measurements and `failed`, a bit for each rule that the text fails."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    outer = [c for c in docs.columns if c not in (*names, "failed") or c == text]
    docs = docs.select(*[docs[f"`{c}`"] for c in outer])
    inner = [f"c{k}" for k in range(len(outer))]
    at = outer.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [measure(x.as_py()) for x in b.column(at)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield {c: b.column(k) for k, c in enumerate(inner)} | dict(zip(names, columns, strict=True))

    out = map_arrow(docs.toDF(*inner), run, carried({c: f.dataType for c, f in zip(inner, docs.schema, strict=True)}, MEASURES))
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules), F.lit(0).cast("long"))
    new = [F.col(x) for x in names] + [bits.alias("failed")]
    return out.select(*[F.col(c).alias(name) for c, name in zip(inner, outer, strict=True)], *new)


def passes(policy: str | tuple[str, ...] = "v1", failed: str = "failed") -> Column:
    """Whether a row of the ledger stays under a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that would stay were it left out."""
    want = mask(policy, rules)
    broken = F.col("failed").bitwiseAND(F.lit(want).cast("long"))
    by_bits = book.groupBy(broken.alias("broken")).count()  # a row for each combination of bits
    cells = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if want >> r.bit & 1]))
    return (
        by_bits.select("broken", "count", cells.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("broken").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("broken") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only_this"))
    )


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The documents that the policy keeps, with their columns as they are."""
    book = ledger(docs.select(whole(docs).alias("row"), docs["text"].cast("string").alias("text")))
    return book.where(passes(policy)).select(*parts_of("row", docs.columns))
