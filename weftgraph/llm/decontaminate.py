"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are dealt to blocks of about `block_words` words; each block becomes one automaton, which
is what a task holds at a time. Documents stream through it word by word and yield the runs of words
that an item's window covers. The driver sends `_TOGETHER` blocks at a time to the tasks; with more
of them, so many are looked up in each pass over the documents, which a written table ends.

Null and empty texts have no words and no hits; null and empty items are never found. Items that
repeat under one item_id count once; documents are judged row by row, whatever their doc_id. A very
long text is held whole by one task, with about 100 bytes for each of its words. Without documents
the result is empty, without items nothing is hit. Other columns of the documents are not read;
decontaminate hands them on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_arrow, parts_of, whole, written

#: Letters, digits and everything beyond ASCII, after lower-casing A-Z.
_ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TEXT_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOGETHER = 16  # blocks in a pass
_CHUNK = 32 << 20  # bytes of text for which a block's automaton is built again, where there are several


def item_words(text: str | None) -> list[bytes]:
    return _ITEM_WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """Recognises every run of words of the items it was fed.

    State 0 is the start. `after[s]` maps a word to the next state, `link[s]` is the state of the
    longest suffix with other ends, `length[s]` the longest run of the state.
    """

    def __init__(self, window: int):
        self.window = window
        self.after: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.found: dict[int, set[str]] = {}  # state of a window: items with it
        self.short: dict[int, list[tuple[int, int]]] = {}  # state: whole short items (words, state) that end there

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.after) - 1

    def _step(self, last: int, word: bytes) -> int:
        """The state of the item so far and this word."""
        after, link, length = self.after, self.link, self.length
        if (there := after[last].get(word)) is not None:
            if length[there] == length[last] + 1:
                return there
            return self._clone(last, word, there)
        new = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p >= 0:
            q = after[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.after[q]))
        self.link[q] = copy
        while p >= 0 and self.after[p].get(word) == q:
            self.after[p][word] = copy
            p = self.link[p]
        return copy

    def feed(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._step(last, w)

    def mark(self, item: str, words: list[bytes]) -> None:
        """Notes the item at the states of its windows; after all items have been fed."""
        state = size = 0
        for w in words:
            state, size = self.after[state][w], size + 1
            state, size = self._cut(state, size, self.window)
            if size == min(self.window, len(words)):
                self.found.setdefault(state, set()).add(item)
        if 0 < len(words) < self.window:
            self.short.setdefault(state, [])
            if (len(words), state) not in self.short[state]:
                self.short[state].append((len(words), state))

    def close(self) -> None:
        """Hands short items down to the states of longer runs that end in them."""
        own, self.short = self.short, {}
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.short.get(self.link[s], []) if s else []
            if got := [*own.get(s, []), *up]:
                self.short[s] = got

    def _cut(self, state: int, size: int, most: int) -> tuple[int, int]:
        while size > most:
            if self.length[self.link[state]] >= most:
                state = self.link[state]
                size = min(size, self.length[state])
            else:
                size = most
        return state, size

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words that windows cover, as (first, after the last), and the items whose windows occur."""
        after, link, length, window = self.after, self.link, self.length, self.window
        start, found, short = after[0], self.found, self.short
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        state = size = 0
        for k, w in enumerate(words):
            if not state:
                if w not in start:
                    continue
                state, size = start[w], 1
            else:
                while state and w not in after[state]:
                    state = link[state]
                    size = length[state]
                if w not in after[state]:
                    size = 0
                    continue
                state, size = after[state][w], size + 1
                if size > window:  # the window that ends here is all that matters
                    state, size = self._cut(state, size, window)
            n = 0
            if size == window and state in found:
                n = window
                items |= found[state]
            if state in short:
                for m, s in short[state]:
                    if size >= m:
                        n = max(n, m)
                        items |= found[s]
            if n:
                first = k + 1 - n
                while out and out[-1][1] >= first:
                    first = min(first, out.pop()[0])
                out.append((first, k + 1))
        return out, items


def _automaton(items: list[tuple[str, list[bytes]]], window: int) -> SuffixAutomaton:
    sam = SuffixAutomaton(window)
    for _, words in items:
        sam.feed(words)
    for item, words in items:
        sam.mark(item, words)
    sam.close()
    return sam


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """(block, i, t) for each item with a text, and the number of blocks; an item's block follows from a hash of it."""
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("i"), benchmark["text"].cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    n = -(-words // block_words)
    return rows.select((F.pmod(F.xxhash64("i", "t"), F.lit(n)) if n else F.lit(0).cast("long")).alias("block"), "i", "t"), n


def _looked_up(texts: list[str | None], blocks: list, window: int, only: SuffixAutomaton | None) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Words, covered runs and items found of each text."""
    n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for b in blocks:
        sam = only or _automaton([(i, item_words(t)) for i, t in b], window)
        for k, t in enumerate(texts):
            if t:
                words = _TEXT_WORD.findall(t.encode("utf-8", "surrogatepass").lower())
                n_words[k] = len(words)
                got, ids = sam.spans(words)
                spans[k] += got
                items[k] |= ids
    return n_words, [merged(s) for s in spans], items


def _pass(rows: DataFrame, names: list[str], blocks: list[list[tuple[str, str]]], window: int, last: bool) -> DataFrame:
    """rows (names, t, spans, items), with what these blocks find added to spans and items, and n_words; without t if it is the last pass."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        blocks = shared.value or [[]]
        only = _automaton([(i, item_words(t)) for i, t in blocks[0]], window) if len(blocks) == 1 else None
        for chunk in chunks(batches, _CHUNK if len(blocks) > 1 else 0):
            n_words, spans, items = _looked_up(chunk.column("t").to_pylist(), blocks, window, only)
            before = [[(p["a"], p["b"]) for p in s] for s in chunk.column("spans").to_pylist()]
            spans = [merged(a + b) if a else b for a, b in zip(before, spans, strict=True)]
            items = [sorted(x.union(y)) for x, y in zip(items, chunk.column("items").to_pylist(), strict=True)]
            kept = {n: chunk.column(n).combine_chunks() for n in kinds}
            yield kept | {"n_words": n_words, "spans": [[{"a": a, "b": b} for a, b in s] for s in spans], "items": items}

    kinds = {n: rows.schema[n].dataType for n in [*names, *(() if last else ("t",))]}
    return map_arrow(rows.select(*names, "t", "spans", "items"), run, carried(kinds, f"n_words long, spans {_SPANS}, items array<string>"))


_SPANS = "array<struct<a:long,b:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 500_000, carry: tuple[str, ...] = ("doc_id",), together: int = _TOGETHER) -> DataFrame:
    """One row per document: the carried columns, n_words, spans (first word, after the last), n_hit, items."""
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(carry, names, strict=True)], docs["text"].cast("string").alias("t"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    by_block, n = _blocks(benchmark, block_words)
    if n > together:
        by_block = written(by_block)
    for first in range(0, max(1, n), together):
        blocks: dict[int, list[tuple[str, str]]] = {}
        for r in by_block.where(F.col("block").between(first, first + together - 1)).toLocalIterator():  # about together * block_words words
            blocks.setdefault(r.block, []).append((r.i, r.t))
        last = first + together >= n
        rows = _pass(rows, names, list(blocks.values()), window, last)
        rows = rows if last else written(rows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "n_words", "spans", n_hit.alias("n_hit"), "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", one_in: int = 20) -> F.Column:
    """At least one word in so many is hit."""
    return (F.col(n_hit) > 0) & (one_in * F.col(n_hit) >= F.col(n_words))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _TEXT_WORD.finditer(raw)]
    keep, done = [], 0
    for a, b in spans:
        keep.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*keep, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """Documents over the coverage limit go; from the others the matched spans are cut, and `n_chars`, if any, is counted anew."""
    rows = docs.select(whole(docs).alias("row"), docs["text"])
    judged = contamination(rows, benchmark, window, carry=("row",)).where(~contaminated(one_in=one_in))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, [(p["a"], p["b"]) for p in s]) if len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    dirty = F.size("spans") > 0
    new = {"text": F.when(dirty, F.pandas_udf(cut, "string")(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dirty, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return judged.select(*parts_of("row", docs.columns, **new))
