"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats over the length threshold.

Each run of `window` words has one anchor: the k words in it with the least hash, the first on a
tie. The runs with one anchor make up a segment, the anchor extended both ways as far as it stays
theirs; a text falls into about 2 / (window - k + 2) segments a word. Occurrences of segments meet
on their anchor. An equal segment is a repeat of the first one in all its runs. The first
occurrences of unlike segments may match in part: where they agree with another one beyond the
anchor on one side by half of what a run has left, their runs are compared. Repeated pieces that lie
side by side in the document and in their earlier occurrence are then joined, past the segments'
ends: these are the maximal repeats.

Anchors that occur once never leave the tasks that find them, but for a few that a `Sieve` lets
through; neither do texts in which nothing repeats. Anchors with more than one in 4096 of all shared
occurrences are hot, so there are fewer than 4096 of them: theirs are dealt by document to 256 parts
each, of which only the first ones meet again.

Words are compared by 64-bit hashes, segments and runs by two of these (anchor and extension).

Null and empty texts have no words. A null doc_id counts as the smallest id. Rows that repeat a
doc_id are separate documents if their texts differ (in the order of a hash of the text) and one
document, with equal results, if not. Texts under `window` words never change; a very long text is
held whole by one task, with about 100 bytes for each of its words. An empty table gives an empty
result. Columns other than doc_id and text are not read; dedup_documents hands them on, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Sieve, WordHashes, gram_hashes, keyed, map_arrow, mix, parts_of, signed, split_words, whole, written

_COUNT_BITS = 6  # of a position; its start comes before them
_HOT, _DEAL = 4096, 256
_CHUNK = 1 << 18  # words looked at together
_THREE, _ODD = np.uint64(3), np.uint64(0x9E3779B97F4A7C15)


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of so many values, where its least value is first found."""
    at, have = np.arange(len(values)), 1

    def joined(values: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        later = values[step:] < values[:-step]
        return np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])

    while have * 2 <= width:
        values, at = joined(values, at, have)
        have *= 2
    return joined(values, at, width - have)[1] if width > have else at


@dataclass
class Segments:
    """The segments of some texts whose word hashes `h` stand end to end; starts count from the beginning of the text."""

    h: np.ndarray
    runs: np.ndarray  # hash of the run at each place in h
    anchor: np.ndarray
    at: np.ndarray  # of the anchor, in h
    first: np.ndarray  # run of each segment, in h
    count: np.ndarray  # of runs
    key: np.ndarray
    place: np.ndarray  # start of the first run and number of runs, packed
    tag: np.ndarray  # hash of the text
    start: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, tags: np.ndarray, sizes: np.ndarray, h: np.ndarray, window: int, k: int) -> Segments:
        runs = gram_hashes(h, window)
        begin = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(runs)]
        whole = np.flatnonzero(np.arange(window, len(h) + 1) <= (begin + sizes)[text])  # runs that stay in their text
        least = first_minima(gram_hashes(h, k), window - k + 1)[whole]
        new = np.flatnonzero(np.diff(least, prepend=-1))
        first, count, at = whole[new], np.diff(new, append=len(whole)), least[new]
        text = text[first]
        start = first - begin[text]
        return cls(h, runs, gram_hashes(h, k)[at], at, first, count, keys[text], _packed(start, count), tags[text], start)

    def some(self, which: np.ndarray) -> Segments:
        return Segments(self.h, self.runs, *(getattr(self, f)[which] for f in ("anchor", "at", "first", "count", "key", "place", "tag", "start")))

    def hashes(self) -> np.ndarray:
        return mix(self.runs[self.first] * _ODD + self.runs[self.first + self.count - 1] * _THREE + self.count.astype(np.uint64))

    def sides(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each anchor with half of what a run has beyond it, to the left and to the right; over a text's ends any value."""
        more = (window - k + 1) // 2
        longer = gram_hashes(self.h, k + more)
        out = []
        for start in (self.at - more, self.at):
            there = (start >= 0) & (start < len(longer))
            side = mix(self.at.astype(np.uint64) + _ODD)
            side[there] = longer[start[there]]
            out.append((side >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return out[0], out[1]


def _segments(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[Segments]:
    """Of texts (columns: k, th, text) that have a run at all, about `_CHUNK` words at a time."""
    hashes = WordHashes()
    held: list[tuple[int, int, np.ndarray]] = []

    def out() -> Segments:
        keys, tags, some = zip(*held, strict=True)
        held.clear()
        return Segments.of(np.array(keys, np.int64), np.array(tags, np.int64), np.fromiter(map(len, some), np.int64, len(some)), np.concatenate(some), window, k)

    size = 0
    for b in batches:
        keys, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
        for key, tag, text in zip(keys, tags, b.column(2), strict=True):
            words = split_words(text.as_py())
            if len(words) >= window:
                held.append((key, tag, hashes.of(words)))
                size += len(words)
                if size >= _CHUNK:
                    yield out()
                    size = 0
    if held:
        yield out()


def _packed(start: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    return (start << _COUNT_BITS) + count


#: What `at` packs, as SQL.
_START = f"shiftright({{}}, {_COUNT_BITS})"
_RUNS = f"{{}} & {(1 << _COUNT_BITS) - 1}L"


def _place_hash(k: np.ndarray, th: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(k.view(np.uint64) * _ODD + th.view(np.uint64)) + at.view(np.uint64) * _THREE)


def _dealt(hot: np.ndarray, anchor: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """0, or for hot anchors one of `_DEAL` parts by the document."""
    out = np.zeros(len(anchor), np.int16)
    if len(hot) and len(anchor):
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        some = hot[at] == anchor
        out[some] = 1 + (mix(keys[some].view(np.uint64) * _ODD) % np.uint64(_DEAL)).astype(np.int16)
    return out


def _anchor_counts(rows: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for s in _segments(batches, window, k):
            anchor, n = np.unique(s.anchor, return_counts=True)
            yield {"anchor": signed(anchor), "n": n}

    return map_arrow(rows, run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _occurrences(rows: DataFrame, window: int, k: int, shared: Sieve, hot: Broadcast) -> DataFrame:
    """anchor, part, segment, left, right, k, th and at of the segments on anchors that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for s in _segments(batches, window, k):
            s = s.some(np.flatnonzero(shared.may_hold(s.anchor)))
            left, right = s.sides(window, k)
            anchor = signed(s.anchor)
            yield {"anchor": anchor, "part": _dealt(hot.value, anchor, s.key), "segment": signed(s.hashes()), "left": left, "right": right, "k": s.key, "th": s.tag, "at": s.place}

    return map_arrow(rows, run, "anchor long, part short, segment long, left int, right int, k long, th long, at long")


def _runs(rows: DataFrame, window: int, k: int, wanted: Sieve, hot: Broadcast) -> DataFrame:
    """anchor, part, segment (here one run), k, th and at of the runs in the segments at places that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for s in _segments(batches, window, k):
            s = s.some(np.flatnonzero(wanted.may_hold(_place_hash(s.key, s.tag, s.place))))
            each = np.repeat(np.arange(len(s.count)), s.count)
            more = np.arange(len(each)) - np.repeat(np.cumsum(s.count) - s.count, s.count)
            anchor, key = signed(s.anchor)[each], s.key[each]
            yield {"anchor": anchor, "part": _dealt(hot.value, anchor, key), "segment": signed(s.runs[s.first[each] + more]), "k": key, "th": s.tag[each], "at": _packed(s.start[each] + more, 1)}

    return map_arrow(rows, run, "anchor long, part short, segment long, k long, th long, at long")


def _marked(found: DataFrame, *extra: Column, deal: str = "part") -> DataFrame:
    """Occurrences with the first one (sk, sat) in their part, and whether they are that one."""
    place = F.struct("k", "th", "at")
    first = F.first(place).over(Window.partitionBy("anchor", "part", "segment").orderBy("k", "th", "at"))
    rows = found.repartition("anchor", deal).select("anchor", "part", "segment", "k", "th", "at", first.alias("first"), *extra)  # which suits all windows
    return rows.select(*[c for c in rows.columns if c != "first"], F.col("first.k").alias("sk"), F.col("first.at").alias("sat"), (place == F.col("first")).alias("is_first"))


def _met_again(marked: DataFrame) -> DataFrame:
    """The first ones of the parts of hot anchors, marked anew against all parts; at most `_DEAL` meet."""
    return _marked(marked.where("is_first AND part > 0").select("anchor", F.lit(0).cast("short").alias("part"), "segment", "k", "th", "at"), deal="segment")


def _alike(side: str) -> Column:
    """Whether an unlike segment has the same hash of this side."""
    w = Window.partitionBy("anchor", "part", side)
    return F.min("segment").over(w) != F.max("segment").over(w)


def _tag(docs: DataFrame) -> Column:
    """Tells rows with one doc_id apart by their texts: the whole hash, since any number of rows can be without an id."""
    return F.xxhash64(docs["text"])


def repeats(docs: DataFrame, window: int = 20, k: int = 5) -> DataFrame:
    """k, th, a, n, sk, sa: n runs from a on in a document (k and a hash of the text) that also stand, earlier, from sa on in sk.

    A run starts earlier with a smaller key, or in the same document before.
    """
    if not 0 < k <= window or window - k + 1 >= 1 << _COUNT_BITS:
        raise ValueError("k must be from 1 to window, and within 62 of it")
    text = docs["text"].cast("string")
    rows = docs.select(keyed(docs).alias("k"), _tag(docs).alias("th"), text.alias("text"))
    often = written(_anchor_counts(rows, window, k).where("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.array(sorted(r.anchor for r in often.where(F.col("n") * _HOT > total).select("anchor").collect()), np.int64)  # fewer than _HOT
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    found = _occurrences(rows, window, k, Sieve(often.select("anchor")), sent)
    marked = _marked(found, (_alike("left") | _alike("right")).alias("partly"))
    gone = F.when(F.col("is_first"), F.col("anchor")).alias("anchor"), F.when(F.col("is_first"), F.col("segment")).alias("segment")
    marked = written(marked.where("NOT is_first OR partly OR part > 0").select(*gone, "part", "k", "th", "at", "sk", "sat", "is_first"))
    again = _met_again(marked)
    unlike = again.groupBy("anchor").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low != high").select("anchor")
    partly = marked.where("is_first AND part = 0").select("k", "th", "at").unionByName(again.where("is_first").join(F.broadcast(unlike), "anchor", "left_semi").select("k", "th", "at"))  # fewer than _HOT anchors

    def place(k: pd.Series, th: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(signed(_place_hash(*(x.to_numpy(np.int64) for x in (k, th, at)))))

    wanted = Sieve(partly.select(F.pandas_udf(place, "long")("k", "th", "at").alias("h")))
    runs = written(_marked(_runs(rows, window, k, wanted, sent)).where("NOT is_first OR part > 0"))
    pieces = [x.where("NOT is_first").select("k", "th", "at", "sk", "sat") for x in (marked, again, runs, _met_again(runs))]
    pieces = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).unionByName(pieces[3])
    return pieces.selectExpr("k", "th", f"{_START.format('at')} AS a", f"{_RUNS.format('at')} AS n", "sk", f"{_START.format('sat')} AS sa")


def joined(a: np.ndarray, n: np.ndarray, sk: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one document that lie side by side here and in their source, joined: a, n, sk, sa of maximal repeats, in runs."""
    order = np.lexsort((a, a - sa, sk))
    a, n, sk, sa = a[order], n[order], sk[order], sa[order]
    if not len(a):
        return a, n, sk, sa
    apart = (sk[1:] != sk[:-1]) | (a[1:] - sa[1:] != a[:-1] - sa[:-1]) | (a[1:] > a[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate([[True], apart]))
    return a[first], np.maximum.reduceat(a + n, first) - a[first], sk[first], sa[first]


def covered(n_words: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words the runs cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


_PIECES = ("a", "n", "sk", "sa")


def _by_document(docs: DataFrame, window: int, k: int) -> tuple[DataFrame, Sieve]:
    """k, th, s (the pieces) of the documents with repeats, and a sieve for the hashes of k and th."""
    pieces = repeats(docs, window, k)
    keys = pieces.select("k", "th").distinct()
    return pieces.groupBy("k", "th").agg(F.collect_list(F.struct(*_PIECES)).alias("s")), Sieve(keys.select(F.xxhash64("k", "th").alias("h")))


def _repeats_of(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """The maximal repeats of each row of a list column of pieces."""
    flat = column.flatten()
    values = [flat.field(x).to_numpy() for x in _PIECES]
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    for start, end in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=True):
        yield joined(*(v[start:end] for v in values))


def maximal_repeats(docs: DataFrame, window: int = 20, k: int = 5) -> DataFrame:
    """doc_id, start, n_words, source_id, source_start: stretches of at least `window` words that also stand earlier, in words from 0.

    Each run of words counts with one earlier place: the first, or with hot anchors the first of its part.
    """
    pieces, _ = _by_document(docs, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for key, (a, n, sk, sa) in zip(keys, _repeats_of(b.column(1)), strict=True):
                yield {"k": np.full(len(a), key), "start": a, "n_words": n + window - 1, "sk": sk, "source_start": sa}

    out = map_arrow(pieces.select("k", "s"), run, "k long, start long, n_words long, sk long, source_start long")
    return out.select(_id("k").alias("doc_id"), "start", "n_words", _id("sk").alias("source_id"), "source_start")


def _id(key: str) -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


def dedup(docs: DataFrame, window: int = 20, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space, per document."""
    by_doc, sieve = _by_document(docs, window, k)
    rows = docs.select(keyed(docs).alias("k"), _tag(docs).alias("th"), docs["text"].cast("string").alias("text")).withColumn("may", sieve.column(F.xxhash64("k", "th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for text, (a, n, _, _) in zip(b.column(1), _repeats_of(b.column(2)), strict=True):
                words = kept = split_words(text.as_py())
                if len(a):
                    kept = [w for w, g in zip(words, covered(len(words), a, n, window).tolist(), strict=True) if not g]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield {"k": b.column(0)} | out

    none = F.lit(None).cast(by_doc.schema["s"].dataType).alias("s")
    schema = "k long, n_words long, n_removed long, kept_sha256 string"
    met = map_arrow(rows.where("may").join(by_doc, ["k", "th"], "left").select("k", "text", "s"), run, schema)
    out = map_arrow(rows.where("NOT may").select("k", "text", none), run, schema).unionByName(met)
    return out.select(_id("k").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def dedup_documents(docs: DataFrame, window: int = 20, k: int = 5) -> DataFrame:
    """docs with the repeated words cut from their texts and `n_chars`, where there is one, counted anew.

    A text that loses nothing stays as it is, a text that loses something has one space between words,
    and a row that loses all its words goes.
    """
    by_doc, sieve = _by_document(docs, window, k)

    def cut(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, pieces, strict=True):
            if some is not None and len(some):
                words = split_words(text)
                a, n, _, _ = joined(*(np.array([x[f] for x in some]) for f in _PIECES))
                gone = covered(len(words), a, n, window)
                text = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = docs.select(whole(docs).alias("row"), keyed(docs).alias("k"), _tag(docs).alias("th"))
    rows = rows.withColumn("may", sieve.column(F.xxhash64("k", "th")))
    met = rows.where("may").join(by_doc, ["k", "th"], "left")
    met = met.select("row", "s", F.pandas_udf(cut, "string")(F.col("row.text"), F.col("s")).alias("cut")).where("s IS NULL OR cut != ''")
    lost = F.col("s").isNotNull()
    new = {"text": F.when(lost, F.col("cut")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.where("NOT may").select(*parts_of("row", docs.columns)).unionByName(met.select(*parts_of("row", docs.columns, **new)))
