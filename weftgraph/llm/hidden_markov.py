"""Hidden Markov language model: Baum-Welch counts summed over partitions, scaled forward recursion for exact likelihoods.

Tokens are the lower-cased words of a text and an end. The most frequent words are classes of their
own, the others share classes by their last letters; a word's probability is that of its class in the
latent state times that of the word within its class. The number of classes grows with the number of
different words, from 5 to 40 thousand; so does what tasks hold and the driver adds up, but no
further. Word counts themselves stay a distributed table, and words outside the table sent to tasks
meet their counts in a join.

Starting values are random; every Baum-Welch pass, and all counts, cover every training text. The first
passes learn block by block: each block of tasks replaces its own counts of the pass before and the
model is estimated anew, which takes about half as many passes as learning at the end of each. Passes
end when the log-likelihood gained per token is under `least_gain` and no longer rising. Texts are
passed through in stretches of steps, of which only the borders are kept until the way back, so that
memory does not grow with the longest text but for 2 bytes a token.

A null or empty text is an end alone. Rows without an id are held out. An empty table gives an empty
result, and where no text is left to learn from every token is unknown. Rows are scored one by one;
columns other than the key and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, lists, map_arrow, most_frequent, written

_END = b"\n"  # no word holds a line break
_HELD_WORDS = 1 << 17
_CHUNK = 1 << 18  # tokens coded together
_CELLS = 1 << 22  # values of the largest array of a stretch
_BLOCKS = 8  # a power of two: times that the model is estimated in the first pass; half as often in each pass after it, down to once


@dataclass(frozen=True)
class Shape:
    states: int = 8
    own: int | None = None  # classes of a single word; by default an eighth of a power of two near the number of different words, from 2^12 to 2^15
    shared: int | None = None  # classes of the other words, a power of two; by default a quarter of own
    known: int = 1 << 17  # words whose counts are sent to tasks
    least_gain: float = 1e-3  # natural log-likelihood per token that a further pass must bring

    def sized(self, kinds: int) -> Shape:
        own = self.own or 1 << min(15, max(12, int(kinds).bit_length() - 6))
        return replace(self, own=own, shared=self.shared or own // 4)

    @property
    def classes(self) -> int:
        return self.own + self.shared


def tokens(text: str | bytes | None) -> list[bytes]:
    """Of a text, or of its UTF-8."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split() if text else []
    words.append(_END)
    return words


def held_out(key: Column, parts: int = 10) -> Column:
    return F.pmod(F.coalesce(F.crc32(key.cast("string")), F.lit(0)), F.lit(parts)) == 0


class Lexicon(dict):
    """Numbers of the words met since the last clearing, with the hash of each word and of its last letters."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self.tails: list[int] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.hashes)
        h = xxhash.xxh3_64_intdigest(word)
        self.hashes.append(h - (1 << 64) if h >> 63 else h)
        self.tails.append(xxhash.xxh3_64_intdigest(word[-3:]) & 0xFFFF)
        return k

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self) > _HELD_WORDS

    def empty(self) -> None:
        self.clear()
        self.hashes, self.tails = [], []


def word_counts(texts: DataFrame) -> DataFrame:
    """h, tail, n: the hash of each word and of its last letters, and how often it occurs."""

    def out(seen: Counter[bytes]) -> dict:
        lexicon = Lexicon()
        lexicon.numbers(list(seen))
        return {"h": lexicon.hashes, "tail": lexicon.tails, "n": list(seen.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > _HELD_WORDS:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    return map_arrow(texts, run, "h long, tail int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))


class Vocabulary:
    """What tasks know of the words: hashes of the most frequent ones, in the order of their counts, and the counts."""

    def __init__(self, hashes: np.ndarray, tails: np.ndarray, counts: np.ndarray, total: int, kinds: int, shape: Shape):
        self.hashes, self.shape = hashes, shape
        self.scale = np.log10(total + 0.1 * (kinds + 1))
        self.logs = np.log10(counts + 0.1)
        at = np.arange(len(hashes))
        self.classes = np.where(at < shape.own, at, self.shared_class(tails))
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def shared_class(self, tails: np.ndarray) -> np.ndarray:
        return self.shape.own + (tails & (self.shape.shared - 1))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash in the vocabulary, or -1."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _chunks(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, column: int) -> Iterator[tuple[pa.RecordBatch, list[int], np.ndarray]]:
    """Rows, the number of tokens of each, and the tokens' numbers end to end, about `_CHUNK` tokens at a time."""
    for b in batches:
        start, size, sizes, held = 0, 0, [], []
        for row, text in enumerate(b.column(column).to_pylist()):
            words = tokens(text)
            sizes.append(len(words))
            held.append(lexicon.numbers(words))
            size += len(words)
            if row + 1 == b.num_rows or size >= _CHUNK:
                yield b.slice(start, row + 1 - start), sizes, np.concatenate(held)
                start, size, sizes, held = row + 1, 0, [], []
                if lexicon.full():
                    lexicon.empty()


def _encoded(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, held_out, n_tokens, codes (classes of the tokens, 16 bits each) and of the tokens: known_n,
    base (sum of log10(c + 0.1)) and inside (sum of log10 of the shares in shared classes) over known words,
    rare (hash and number) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        v: Vocabulary = shared.value
        for b, sizes, numbers in _chunks(batches, lexicon := Lexicon(), 2):
            hashes, tails = np.array(lexicon.hashes, np.int64), np.array(lexicon.tails, np.int64)
            place = v.places(hashes)
            known = place >= 0
            if len(v.hashes):
                classes = np.where(known, v.classes[place], v.shared_class(tails))
                logs = np.where(known, v.logs[place], 0.0)
            else:
                classes, logs = v.shared_class(tails), np.zeros(len(hashes))
            starts = np.cumsum(sizes) - sizes
            rare = np.flatnonzero(~known[numbers])
            text = np.repeat(np.arange(len(sizes)), sizes)[rare]
            pairs, times = np.unique((text << 32) + numbers[rare], return_counts=True)
            many = np.bincount(pairs >> 32, minlength=len(sizes)).tolist()
            codes = classes.astype(np.uint16)[numbers]
            yield {
                "doc_id": b.column(0), "held_out": b.column(1), "n_tokens": sizes,
                "codes": [codes[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes, strict=True)],
                "known_n": np.add.reduceat(known[numbers], starts, dtype=np.int64), "base": np.add.reduceat(logs[numbers], starts),
                "inside": np.add.reduceat(np.where(known & (place >= v.shape.own), logs, 0.0)[numbers], starts),
                "rare_h": lists(hashes[pairs & 0xFFFFFFFF], many, pa.int64()), "rare_n": lists(times, many, pa.int64()),
            }

    return map_arrow(rows, run, carried({"doc_id": rows.schema["doc_id"].dataType}, "held_out boolean, n_tokens long, codes binary, known_n long, base double, inside double, rare_h array<long>, rare_n array<long>"))


@dataclass
class Model:
    """start[s], move[s, t], emit[class, s]: probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def as_type(self, kind: type) -> Model:
        return Model(self.start.astype(kind), self.move.astype(kind), self.emit.astype(kind))


def _grouped(codes: list[np.ndarray], states: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of like length side by side: their numbers, lengths (falling) and classes by step and text."""
    length = np.fromiter(map(len, codes), np.int64, len(codes))
    order = np.argsort(-length, kind="stable")
    k = 0
    while k < len(order):
        wide = min(1024, max(32, _CELLS // (int(length[order[k]]) * states)))
        at = order[k : k + wide]
        table = np.zeros((int(length[at[0]]), len(at)), np.uint16)
        for j, d in enumerate(at.tolist()):
            table[: length[d], j] = codes[d]
        yield at, length[at], table
        k += wide


def _active(length: np.ndarray, steps: int) -> np.ndarray:
    """How many texts have so many tokens, for each step."""
    return np.searchsorted(-length, -np.arange(1, steps + 1), "right")


def _emitted(model: Model, codes: np.ndarray) -> np.ndarray:
    """By state, step and text."""
    out = np.empty((len(model.start), *codes.shape), model.emit.dtype)
    for s, column in enumerate(np.ascontiguousarray(model.emit.T)):
        np.take(column, codes, out=out[s], mode="clip")  # no code is out of bounds
    return out


def _ahead(model: Model, codes: np.ndarray, active: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values by state, step and text, scales by step and text, and the last values of each text; before: those of the step before."""
    values = _emitted(model, codes)
    scales = np.ones(codes.shape, values.dtype)
    last = np.zeros((len(model.start), codes.shape[1]), values.dtype) if before is None else before.copy()
    move = np.ascontiguousarray(model.move.T)
    for t, m in enumerate(active.tolist()):
        x = values[:, t, :m]
        x *= model.start[:, None] if before is None and t == 0 else move @ last[:, :m]
        np.add.reduce(x, axis=0, out=scales[t, :m])
        x /= scales[t, :m]
        last[:, :m] = x
        values[:, t, m:] = 0
    return values, scales, last


def _stretches(table: np.ndarray, states: int) -> list[tuple[int, int]]:
    step = max(16, _CELLS // (table.shape[1] * states))
    return [(t, min(t + step, len(table))) for t in range(0, len(table), step)]


def forward(model: Model, table: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each column."""
    active, last, log = _active(length, len(table)), None, np.zeros(table.shape[1])
    for a, b in _stretches(table, len(model.start)):
        _, scales, last = _ahead(model, table[a:b].astype(np.intp), active[a:b], last)
        log += np.log(scales).sum(axis=0, dtype=float)
    return log


class Counts:
    """Expected counts of starts, moves and emissions, and the log-likelihood."""

    def __init__(self, classes: int, states: int):
        self.start, self.move, self.emit, self.log = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0

    def add(self, model: Model, table: np.ndarray, length: np.ndarray) -> None:
        active, stretches = _active(length, len(table)), _stretches(table, len(model.start))
        borders: list[np.ndarray | None] = [None]
        for a, b in stretches[:-1]:
            borders.append(_ahead(model, table[a:b].astype(np.intp), active[a:b], borders[-1])[2])
        after = np.ones((len(model.start), table.shape[1]), model.start.dtype)  # the backward values of the step after
        for (a, b), before in zip(reversed(stretches), reversed(borders), strict=True):
            self._back(model, table[a:b].astype(np.intp), active[a:b], before, after)

    def _back(self, model: Model, codes: np.ndarray, active: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> None:
        """Adds a stretch; changes `after` to the backward values before it."""
        ahead, scales, _ = _ahead(model, codes, active, before)
        self.log += float(np.log(scales).sum(dtype=float))
        back = _emitted(model, codes)
        for t in range(len(codes) - 1, -1, -1):
            m = active[t]
            x = back[:, t, :m]
            x *= after[:, :m]
            x /= scales[t, :m]
            after[:, :m] = model.move @ x
            back[:, t, m:] = 0
        k, n = len(model.start), codes.shape[1]
        ahead, back = ahead.reshape(k, -1), back.reshape(k, -1)
        self.move += ahead[:, :-n] @ back[:, n:].T
        chance = back  # of each state, from here on
        if before is None:
            chance[:, :n] *= model.start[:, None]
            self.start += chance[:, :n].sum(axis=1, dtype=float)
        else:
            self.move += before @ back[:, :n].T
            chance[:, :n] *= model.move.T @ before
        chance[:, n:] *= model.move.T @ ahead[:, :-n]
        flat = codes.ravel()
        for s in range(k):  # steps after a text's end weigh nothing
            self.emit[:, s] += np.bincount(flat, chance[s], len(self.emit))

    def add_all(self, model: Model, codes: list[np.ndarray]) -> None:
        for _, length, table in _grouped(codes, len(model.start)):
            self.add(model, table, length)


def estimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, old: np.ndarray, share: np.ndarray, weight: float = 50.0) -> Model:
    """The model with these expected counts; moves are counted but for the factor of the old model's moves.

    Emissions lean on the classes' shares of all tokens with the weight of so many tokens.
    """
    states = len(start)
    start = (start + 0.1) / (start.sum() + 0.1 * states)
    move = (move * old + 0.1) / ((move * old).sum(axis=1, keepdims=True) + 0.1 * states)
    emit = (emit + weight * share[:, None]) / (emit.sum(axis=0) + weight)
    return Model(start, move, emit)


def _first_model(share: np.ndarray, shape: Shape) -> Model:
    """Starting values: the classes' shares of all tokens, changed at random for each state; states tend to stay."""
    rng = np.random.default_rng(7)
    k = shape.states
    noise = rng.dirichlet(np.ones(k), len(share)) * k
    emit = share[:, None] * (0.5 + 0.5 * noise)
    move = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _pass(coded: DataFrame, model: Broadcast, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts and the log-likelihood over all training texts: tasks add up their own, Spark adds up the tasks'."""
    k, classes = shape.states, shape.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c, single = Counts(classes, k), model.value.as_type(np.float32)
        for b in batches:
            c.add_all(single, _codes(b.column(0)))
        rows = np.concatenate([c.emit, c.move, c.start[None], np.full((1, k), c.log)])
        some = np.flatnonzero(rows.any(axis=1))
        yield {"cell": some.astype(np.int32)} | {f"s{s}": rows[some, s].astype(np.float32) for s in range(k)} | {"log": np.where(some == len(rows) - 1, c.log, 0.0)}

    kind = "cell int, " + ", ".join(f"s{s} float" for s in range(k)) + ", log double"
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in (*(f"s{s}" for s in range(k)), "log")]
    got = map_arrow(coded.where("NOT held_out").select("codes"), run, kind).groupBy("cell").agg(*sums).toPandas()
    rows = np.zeros((classes + k + 2, k))  # as many rows as classes and states
    rows[got["cell"].to_numpy(np.int64)] = got[[f"s{s}" for s in range(k)]].to_numpy()
    return rows[-2], rows[classes:-2], rows[:classes], float(got["log"].sum())


def fitted(coded: DataFrame, share: np.ndarray, total: int, shape: Shape) -> Model:
    """Baum-Welch over all training texts until a pass gains less than `least_gain` a token, and no more than the one before.

    A pass of several groups of blocks estimates the model after each, from the latest counts of every
    block; before a sixteenth of all tokens is counted the starting values stay. Only passes of one
    group are compared, so the last two count every text under one model each.
    """
    context = coded.sparkSession.sparkContext
    model, logs, held, groups, whole = _first_model(share, shape), [], {}, _BLOCKS, 0
    while total:
        done, log = {}, 0.0
        for g in range(groups):
            sent = context.broadcast(model)
            start, move, emit, part = _pass(coded.where(F.pmod("block", F.lit(groups)) == g), sent, shape)
            sent.unpersist()
            done[g], log = (start, move * model.move, emit), log + part
            start, move, emit = (sum(c) for c in zip(*done.values(), *(c for j, c in held.items() if j % groups not in done), strict=True))
            if emit.sum() * 2 * _BLOCKS >= total:
                model = estimated(start, move, emit, np.ones_like(move), share)
        logs.append(log / total)
        whole += groups == 1
        if whole > 1 and logs[-1] - logs[-2] < min(shape.least_gain, logs[-2] - logs[-3]):
            break
        held, groups = done, max(1, groups // 2)
    return model


def _class_sums(counts: DataFrame, own: np.ndarray, shape: Shape) -> np.ndarray:
    """What the words of each class add up to, each counted 0.1 more often than it occurs."""
    top = F.broadcast(counts.sparkSession.createDataFrame([(int(h), k) for k, h in enumerate(own)], "h long, place int"))  # at most shape.own rows
    cell = F.coalesce(F.col("place"), (F.lit(shape.own) + F.col("tail").bitwiseAND(F.lit(shape.shared - 1))).cast("int"))
    got = counts.join(top, "h", "left").groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    out = np.zeros(shape.classes)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float) + 0.1 * got["kinds"].to_numpy(float)
    return out


def score(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id") -> DataFrame:  # noqa: B008
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("doc_id"), held_out(docs[key]).alias("held_out"), docs["text"].cast("string").cast("binary").alias("text"))
    counts = written(word_counts(rows.where("NOT held_out").select("text")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shape = shape.sized(kinds)
    top = most_frequent(counts, shape.known)
    v = Vocabulary(top["h"].to_numpy(np.int64), top["tail"].to_numpy(np.int64), top["n"].to_numpy(np.int64), int(total), int(kinds), shape)
    coded = written(_encoded(rows, spark.sparkContext.broadcast(v)).withColumns({"row": F.monotonically_increasing_id(), "block": F.pmod(F.spark_partition_id(), F.lit(_BLOCKS))}), "block")
    sums = _class_sums(counts, v.hashes[: shape.own], shape)
    share = (sums + 0.1) / (sums.sum() + 0.1 * len(sums))
    model = fitted(coded, share, int(total), shape)
    sent = spark.sparkContext.broadcast((model, np.log10(sums + 0.1)))

    kept = ["row", "doc_id", "held_out", "n_tokens", "known_n", "base", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model, logs = sent.value
        logs = np.where(np.arange(len(logs)) < shape.own, 0.0, logs)  # of what each shared class holds, an unknown word included
        for batch in batches:
            codes = _codes(batch.column(len(kept)))
            out = np.zeros(len(codes))
            for at, length, table in _grouped(codes, shape.states):
                out[at] = forward(model, table, length) / np.log(10)
            yield dict(zip(kept, batch.columns, strict=False)) | {"classes": out, "held": [float(logs[c].sum()) for c in codes]}

    likely = map_arrow(coded.select(*kept, "codes"), run, carried({c: coded.schema[c].dataType for c in kept}, "classes double, held double"))
    rare = coded.where(F.size("rare_h") > 0).select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("row", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("m"))
    met = rare.join(counts, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known"), F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_log"))
    rest = F.coalesce("rare_log", F.lit(0.0))
    return likely.join(met, "row", "left").select(
        F.col("doc_id").alias(key), "held_out", "n_tokens",
        (F.col("known_n") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(float(v.scale))).alias("base_score"),
        (F.col("classes") + F.col("inside") + rest - F.col("held")).alias("score"),
    )
