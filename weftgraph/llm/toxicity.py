"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters are words and word beginnings that labelled toxic texts hold much more often than others,
the best ones each by itself and all others of them as one more voter, and fixed patterns. The label model estimates how often each voter fires in toxic and in other
texts, with a text's label, where there is one, as one more voter, by expectation maximisation over
all training texts. Voters that fire together beyond what the class explains count as correlated,
and count for less when they fire together. A logistic regression is then fitted by Newton steps, summed over
partitions, to the posterior labels of all training texts.

At most about `most_labels` labelled texts, by a hash of the id, give the lexicon and the labels: of
these texts every word and beginning is weighed. All other counts and steps take every training text. Labels of held-out texts are never read.

Null and empty texts have no words and get the score of a text in which no voter fires. Rows without
an id are held out; an id's label is the largest of its rows in labels, null labels are none. An
empty table gives an empty result; without toxic labels only the patterns vote. A very long text is
held whole by one task, with about 100 bytes for each of its words. Columns other than the key and
text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, WordHashes, carried, checkpointed, gram_hashes, map_arrow, mix, signed, split_words, written

_WORDS = re.compile(r"[^\W\d_]+").findall
STEMS = (4, 5, 6)  # letters of the word beginnings
#: Fixed patterns, which need no lexicon.
PATTERNS = (
    ("shouting", re.compile(r"!!!|\?!\?|!\?!")),
    ("upper_run", re.compile(r"(?:\b[A-Z]{3,}\b[ ,]*){4}")),
    ("masked_word", re.compile(r"\b\w[*#@$%]{2,}\w?\b")),
    ("stretched", re.compile(r"([^\W\d_])\1{4}")),
    ("threat", re.compile(r"\b(?:i will|i'll|we will) (?:kill|hurt|destroy|find) you\b", re.I)),
)
#: What a text must hold for a pattern to be tried: plain searches are much the faster.
_NEEDED: dict[str, Callable[[str], object]] = {
    "shouting": lambda text: "!" in text, "masked_word": lambda text: any(c in text for c in "*#@$%"), "threat": lambda text: " you" in text.lower(),
    "upper_run": re.compile("[A-Z]{3}").search, "stretched": lambda text: any(c * 5 in text for c in set(text)),
}


def matched(name: str, pattern: re.Pattern[str], text: str) -> bool:
    return bool(_NEEDED[name](text)) and pattern.search(text) is not None


@dataclass(frozen=True)
class Setup:
    most_labels: int = 250_000
    voters: int = 96
    least_lift: float = 4.0
    least_ratio: float = 24.0  # log-likelihood ratio; of 30,000 chance features hardly one reaches it
    label_rounds: int = 3
    newton_steps: int = 7
    ridge: float = 1.0
    together: float = 0.3  # correlation given the class from which voters form a group


def held_out(key: Column, parts: int = 5) -> Column:
    return F.pmod(F.coalesce(F.crc32(key.cast("string")), F.lit(0)), F.lit(parts)) == 0


def features(text: str | None) -> Counter[str]:
    """How often each word of the text occurs; letters alone, in lower case."""
    return Counter(_WORDS(text.lower())) if text else Counter()


def stems(word: str) -> list[str]:
    """A word as `word` and its beginnings as `begin*`."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def known_labels(labels: DataFrame, most: int) -> DataFrame:
    """k, label of at most about so many labelled training ids: a sample of bounded size."""
    rows = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels["doc_id"]))
    rows = rows.groupBy(rows["doc_id"].cast("long").alias("k")).agg((F.max(rows["toxic"]) > 0).cast("int").alias("label"))
    n = rows.count()
    share = 1 << 20 if n <= most else (1 << 20) * most // n
    return rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share)


def unlike(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ids among rows (k, label, text) without most of the near copies, which would make chance words look like toxic ones.

    Texts of one label with the same four least hashes of their runs of n words, each in an order of
    its own, count once: texts that share half of their runs do so in one of 16 cases, near copies at
    0.95 in four of five. There are at most as many ids as labels were kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for b in batches:
            least = np.zeros((4, b.num_rows), np.uint64)
            for row, text in enumerate(b.column(2)):
                if words := split_words((text.as_py() or "").lower()):
                    grams = gram_hashes(hashes.of(words), min(n, len(words)))
                    for j in range(4):
                        grams = mix(grams + np.uint64(j))
                        least[j, row] = grams.min()
            yield {"k": b.column(0), "label": b.column(1)} | {f"m{j}": signed(least[j]) for j in range(4)}

    seen = map_arrow(rows.select("k", "label", "text"), run, "k long, label int, m0 long, m1 long, m2 long, m3 long")
    return seen.groupBy("label", "m0", "m1", "m2", "m3").agg(F.min("k").alias("k")).select("k")


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass"))


def least_toxic_texts(toxic: int, other: int, ratio: float) -> int | None:
    """The fewest toxic texts that a feature must be in to reach the likelihood ratio at all, where no other text holds it; None if none can."""
    counts = np.arange(1, toxic + 1)
    fit = np.flatnonzero(likelihood_ratio(counts.astype(float), np.zeros(len(counts)), toxic, other) >= ratio)
    return int(counts[fit[0]]) if len(fit) else None


def _counted(rows: DataFrame, sieve: Sieve | None) -> DataFrame:
    """f, h, toxic, other: the labelled texts of either class that hold a word or beginning, of those that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()  # by label
        of: dict[str, list[str]] = {}

        def out() -> dict:
            f = list(seen[0] | seen[1])
            return {"f": f, "h": signed(np.fromiter(map(_hash, f), np.uint64, len(f))), "toxic": [seen[1][x] for x in f], "other": [seen[0][x] for x in f]}

        for b in batches:
            found = [features(text).keys() for text in b.column(1).to_pylist()]
            if len(of) > 300_000:
                of.clear()
            new = [w for w in set().union(*found) if w not in of]
            parts = [stems(w) for w in new]
            if sieve is not None:  # of all new words at once
                flat = [s for p in parts for s in p]
                held = iter(sieve.may_hold(np.fromiter(map(_hash, flat), np.uint64, len(flat))).tolist())
                parts = [[s for s in p if next(held)] for p in parts]
            of.update(zip(new, parts, strict=True))
            for label, ws in zip(b.column(0).to_pylist(), found, strict=True):
                seen[label].update({s for w in ws for s in of[w]})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
                for x in seen:
                    x.clear()
        yield out()

    got = map_arrow(rows.select("label", "text"), run, "f string, h long, toxic long, other long")
    return got.groupBy("f", "h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _telling(rows: DataFrame, setup: Setup) -> list[tuple[float, str]]:
    """-ratio and feature of every word and beginning that passes the tests of lift and ratio, the best first.

    Features of too few toxic texts to pass are told by a sieve before the others are counted; counts
    and tests stay in Spark, so that only what passes comes to the driver: each of these is in several
    of at most about `most_labels` texts.
    """
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic_texts, other_texts = n.get(1, 0), n.get(0, 0)
    least = least_toxic_texts(toxic_texts, other_texts, setup.least_ratio)
    if least is None:
        return []
    often = written(_counted(rows.where("label = 1"), None).where(F.col("toxic") >= least).select("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            toxic, other = (b.column(k).to_numpy().astype(float) for k in (1, 2))
            lift = np.log((toxic + 0.5) / (toxic_texts + 1)) - np.log((other + 0.5) / (other_texts + 1))
            ratio = likelihood_ratio(toxic, other, toxic_texts, other_texts)
            fit = np.flatnonzero((lift >= np.log(setup.least_lift)) & (ratio >= setup.least_ratio))
            yield {"f": b.column(0).take(pa.array(fit)), "ratio": ratio[fit]}

    passed = map_arrow(_counted(rows, Sieve(often)).select("f", "toxic", "other"), run, "f string, ratio double")
    return sorted((-r.ratio, r.f) for r in passed.collect())


def likelihood_ratio(toxic: np.ndarray, other: np.ndarray, toxic_texts: float, other_texts: float) -> np.ndarray:
    """Of the table of texts by class and by whether they hold the feature, against independence."""
    share = toxic_texts / max(1.0, toxic_texts + other_texts)
    out = np.zeros(len(toxic))
    for a, b in ((toxic, other), (toxic_texts - toxic, other_texts - other)):
        for seen, rate in ((a, share), (b, 1 - share)):
            expected = np.maximum((a + b) * rate, 1e-9)
            out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0)
    return out


def lexicon(rows: DataFrame, setup: Setup) -> list[list[str]]:
    """The features of each voter: the ones that tell toxic texts best, one for each stem, and in the last voter all others that pass."""
    out: list[str] = []
    for _, feature in _telling(rows, setup):
        stem = feature.rstrip("*")
        if any(stem.startswith(x.rstrip("*")) for x in out if x.endswith("*")) or any(x.startswith(stem) for x in out):
            continue  # another voter on this stem is the better one
        out.append(feature)
    alone, rest = out[: setup.voters], out[setup.voters :]
    return [[w] for w in alone] + ([rest] if rest else [])


def voted(rows: DataFrame, words: list[list[str]]) -> DataFrame:
    """doc_id, held_out, label, n_words and votes (of each voter and pattern, a byte: how often, at most 255)."""
    n = len(words) + len(PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at = {w: k for k, some in enumerate(words) for w in some}
        of: dict[str, list[int]] = {}
        for b in batches:
            votes = np.zeros((b.num_rows, n), np.uint8)
            sizes = []
            for row, value in enumerate(b.column(3)):
                found = features(text := value.as_py())
                sizes.append(found.total())
                for w, times in found.items():
                    if (hits := of.get(w)) is None:
                        if len(of) > 300_000:
                            of.clear()
                        hits = of[w] = [at[s] for s in stems(w) if s in at]
                    for k in hits:
                        votes[row, k] = min(255, int(votes[row, k]) + times)
                for k, (name, pattern) in enumerate(PATTERNS if text else (), len(words)):
                    votes[row, k] = matched(name, pattern, text)
            yield {"doc_id": b.column(0), "held_out": b.column(1), "label": b.column(2), "n_words": sizes, "votes": [v.tobytes() for v in votes]}

    return map_arrow(rows.select("doc_id", "held_out", "label", "text"), run, carried({"doc_id": rows.schema["doc_id"].dataType}, "held_out boolean, label int, n_words long, votes binary"))


def _summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what fn makes of batches of (votes, n_words, label or -1): a vector of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(size)
        for b in batches:
            total += fn(*_arrays(b))
        some = np.flatnonzero(total)
        yield {"cell": some.astype(np.int32), "x": total[some]}

    got = map_arrow(rows.select("votes", "n_words", "label"), run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[got["cell"].to_numpy(np.int64)] = got["x"].to_numpy(float)
    return out


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    votes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return votes, b.column(1).to_numpy().astype(float), b.column(2).fill_null(-1).to_numpy().astype(int)


@dataclass
class LabelModel:
    """fires[c, j]: the chance that voter j fires in class c; silent[c]: that none does; gold[c]: that a label is 1.

    group[j] numbers the sets of correlated voters, together[g] is their mean correlation. A voter that
    does not fire abstains; k voters of a group that fire count as k / (1 + together * (k - 1)) of them.
    """

    prior: float
    fires: np.ndarray
    silent: np.ndarray
    gold: np.ndarray
    group: np.ndarray
    together: np.ndarray

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        fired = (votes > 0).astype(float)
        member = (self.group[:, None] == np.arange(len(self.together))).astype(float)
        evidence = (fired * np.log(self.fires[1] / self.fires[0])) @ member / (1 + self.together * np.maximum(0, fired @ member - 1))
        odds = np.log(self.prior / (1 - self.prior)) + evidence.sum(axis=1)
        for seen, chance in ((fired.sum(axis=1) == 0, self.silent), (labels == 1, self.gold), (labels == 0, 1 - self.gold)):
            odds += np.where(seen, np.log(chance[1] / chance[0]), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(train: DataFrame, voters: int, setup: Setup) -> LabelModel:
    """Expectation maximisation from the labelled texts on; correlations are taken before the last rounds."""

    def counts(votes: np.ndarray, q: np.ndarray, labels: np.ndarray) -> np.ndarray:
        f, both = (votes > 0).astype(float), np.stack([1 - q, q])
        return np.concatenate([(both @ f).ravel(), both.sum(axis=1), both @ (f.sum(axis=1) == 0), both @ (labels >= 0), both @ (labels == 1)])

    def known(votes: np.ndarray, _: np.ndarray, labels: np.ndarray) -> np.ndarray:
        some = labels >= 0
        return counts(votes[some], labels[some].astype(float), labels[some])

    def model(x: np.ndarray, group: np.ndarray, together: np.ndarray) -> LabelModel:
        fires, (n, silent, labelled, ones) = x[: 2 * voters].reshape(2, voters), x[2 * voters :].reshape(4, 2)
        gold = (ones + np.array([0.02, 0.98]) * 20) / (labelled + 20)  # labels are taken to be good unless the texts say otherwise
        return LabelModel(float((n[1] + 1) / (n.sum() + 10)), (fires + 0.05) / (n[:, None] + 1), (silent + 0.5) / (n + 1), gold, group, together)

    size = 2 * voters + 8
    m = model(_summed(train, known, size), np.arange(voters), np.zeros(voters))
    for k in range(2 * setup.label_rounds):
        if k == setup.label_rounds:
            m.group, m.together = correlated(_correlation(train, m, voters), setup.together)
        m = model(_summed(train, lambda votes, _, labels, m=m: counts(votes, m.posterior(votes, labels), labels), size), m.group, m.together)
    return m


def _correlation(train: DataFrame, m: LabelModel, voters: int) -> np.ndarray:
    """Correlation of each two voters given the class."""

    def moments(votes: np.ndarray, _: np.ndarray, labels: np.ndarray) -> np.ndarray:
        q, f = m.posterior(votes, labels), (votes > 0).astype(float)
        rest = [(f - m.fires[c]) * np.sqrt(w)[:, None] for c, w in ((0, 1 - q), (1, q))]
        return (rest[0].T @ rest[0] + rest[1].T @ rest[1]).ravel()

    cov = _summed(train, moments, voters * voters).reshape(voters, voters)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(spread, spread)


def correlated(correlation: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The group of each voter, by such correlations, and the mean correlation of each group."""
    group = np.arange(len(correlation))
    for a, b in np.argwhere(np.triu(correlation, 1) >= least):
        group[group == group[b]] = group[a]
    group = np.unique(group, return_inverse=True)[1]
    sizes = np.bincount(group)
    sums = np.array([correlation[np.ix_(at, at)].sum() - len(at) for at in (np.flatnonzero(group == g) for g in range(len(sizes)))])
    return group, np.clip(sums / np.maximum(1, sizes * (sizes - 1)), 0, 1)


def design(votes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: one, which voters fire, and how much."""
    hits = votes.sum(axis=1).astype(float)
    return np.column_stack([np.ones(len(votes)), votes > 0, np.log1p(hits), np.minimum(1, 20 * hits / np.maximum(1, n_words)), np.log1p(n_words) / 10])


def classifier(train: DataFrame, m: LabelModel, voters: int, setup: Setup) -> np.ndarray:
    """Weights of the logistic regression on posterior labels."""
    size = voters + 4
    w = np.zeros(size)
    for _ in range(setup.newton_steps):

        def step(votes: np.ndarray, n_words: np.ndarray, labels: np.ndarray, w=w) -> np.ndarray:
            x = design(votes, n_words)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([x.T @ (m.posterior(votes, labels) - p), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

        got = _summed(train, step, size + size * size)
        w = w + np.linalg.solve(got[size:].reshape(size, size) + setup.ridge * np.eye(size), got[:size] - setup.ridge * w)
    return w


def score(docs: DataFrame, labels: DataFrame, setup: Setup = Setup(), key: str = "doc_id") -> DataFrame:  # noqa: B008
    """key, held_out, score and predicted for each row of docs."""
    rows = docs.select(docs[key].alias("doc_id"), held_out(docs[key]).alias("held_out"), docs[key].cast("long").alias("k"), docs["text"].cast("string").alias("text"))
    known = F.broadcast(checkpointed(known_labels(labels, setup.most_labels)))  # its size is bounded
    marked = rows.join(known, "k", "left").select("doc_id", "held_out", F.when(~F.col("held_out"), F.col("label")).alias("label"), "text")
    kept = F.broadcast(checkpointed(unlike(rows.join(known, "k")).join(known, "k").distinct()))
    words = lexicon(rows.join(kept, "k").select("label", "text"), setup)
    votes = checkpointed(voted(marked, words))
    train, voters = votes.where("NOT held_out"), len(words) + len(PATTERNS)
    w = classifier(train, label_model(train, voters, setup), voters, setup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = design(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column(3).to_numpy().astype(float))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield {"doc_id": b.column(0), "held_out": b.column(1), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    out = map_arrow(votes.select("doc_id", "held_out", "votes", "n_words"), run, carried({"doc_id": votes.schema["doc_id"].dataType}, "held_out boolean, score double, predicted int"))
    return out.withColumnRenamed("doc_id", key)
