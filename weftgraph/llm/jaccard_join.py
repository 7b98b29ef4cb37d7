"""N-gram Jaccard join with signature trees: exact links between texts by the overlap of their word n-grams.

A text's set holds the distinct hashes of its runs of n words (of all its words, if fewer). Equal
sets are one class. For each band of sizes the n-grams are dealt by hash to more parts than sets of
these sizes may differ by n-grams, so that sets over the threshold agree on some part; the least
class with a part's content is its centre, and classes that agree on a part meet under its centre,
or under the least centre that this one has itself. That routing makes the roots of a forest.

Within a root, sets of one size band form a tree: leaves hold a bitmap of the set, inner nodes the
OR of their children's bitmaps and their range of sizes. Two nodes can share at most the bits
common to both plus the n-grams that collide in the smaller excess; a dual traversal drops pairs of
nodes whose bound is under what the threshold asks. Pairs of leaves that are left and not yet
connected are counted exactly. Roots over the block size are cut into blocks which all hold the
centre; afterwards only what the centre's component does not hold meets the other blocks.

Texts that have a common phrase, not more, agree on a part by chance, the more of them the larger the
corpus. So a set does without its most frequent keys, as far as the pigeonhole allows, and groups first
meet by marks, small bitmaps of their sets with the same bounds as the leaves of trees; only texts
whose marks allow a link are sent to be counted.

Links come as a spanning forest: no link between different texts is lost to the components, though
copies and connected texts are not expanded into all pairs.

Keys that one set alone has never meet others, but for a few that a `Sieve` lets through, and neither
do texts outside the roots. Keys with more than one in 4096 of all shared ones meet their centres by a
broadcast of these, fewer than 4096; the rows of centres and of equal sets are dealt to several tasks.

Null, empty and blank texts have the empty set and are linked with nothing. Rows that repeat a
doc_id are documents of their own; a null doc_id takes part, but names a component only if no other
id is in it. Sets are told apart by 64-bit hashes. A very long text is held whole by one task, with
about 100 bytes for each of its words. An empty table gives an empty result. Columns other than
doc_id and text are not read; one_of_each hands them on, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.traverse import components
from weftgraph.plans.shared import met, met_by_count

from .common import Sieve, WordHashes, gram_hashes, keyed, lists, map_arrow, mix, parts_of, signed, whole, written

_FANOUT = 8
_PAIR_WORDS = 1 << 20  # bitmap words compared at a time
_GRAMS = 2048  # n-grams for each set of a block
_HOT = 4096
_FREQUENT = 1 << 20
_HELD_SETS = 200_000  # whose keys a task remembers to have given
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """n words in an n-gram; sets link when over * common >= part * union."""

    n: int = 5
    part: int = 80
    over: int = 100

    def least_common(self, sizes):
        """The n-grams that two sets with so many together must share."""
        return -(-self.part * sizes // (self.part + self.over))

    def least_partner(self, size):
        return -(-self.part * size // self.over)

    def alone(self, size: int) -> bool:
        """Whether a set of this size can link with no other set."""
        return self.over * size < self.part * (size + 1)

    def most_partner(self, size: int) -> int:
        return self.over * size // self.part


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the text's n-grams, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
    return gram_hashes(hashes.of(words), min(n, len(words))) if words else np.empty(0, np.uint64)


def set_id(members: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64))


def _edges() -> list[int]:
    """Where bands of sizes begin."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4 if out[-1] < 64 else out[-1] * 3 // 2))
    return out


_BANDS = _edges()


@lru_cache
def parts(how: Likeness, band: int) -> tuple[int, int]:
    """(m, z): sets of a band's sizes that link agree on at least z + 1 of m parts."""
    low, high = _BANDS[band], _BANDS[band + 1] - 1
    differ = (how.over - how.part) * 2 * high // (how.over + how.part)
    z = 1
    for _ in range(4):  # a little over the empty parts that a set of the least size will have
        m = differ + 1 + z
        z = max(1, math.ceil(1.5 * m * math.exp(-how.least_partner(low) / m)))
    return differ + 1 + z, z


class Frequent:
    """The keys that many sets have, in an order that all tasks share: the most frequent first, of equal ones the least."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        """keys in ascending order, and how often there is each."""
        self.keys, place = keys, np.empty(len(keys), np.int32)
        place[np.lexsort((keys, -n))] = np.arange(len(keys), dtype=np.int32)
        self.place = place

    @classmethod
    def of(cls, often: DataFrame, total: int) -> Frequent:
        """Those that more than one in `_FREQUENT` of all keys are, so fewer than that."""
        some = often.where(F.col("n") * _FREQUENT > total).toPandas()
        keys, n = some["key"].to_numpy(np.int64).view(np.uint64), some["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        return cls(keys[order], n[order])

    def without(self, keys: np.ndarray, most: int) -> np.ndarray:
        """keys but for the first `most` of them in the order, or as many as are in it."""
        if most < 1 or not len(self.keys):
            return keys
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        found = np.flatnonzero(self.keys[at] == keys)
        if len(found) > most:
            found = found[np.argpartition(self.place[at[found]], most - 1)[:most]]
        return np.delete(keys, found)


def part_keys(members: np.ndarray, how: Likeness, frequent: Frequent | None = None) -> np.ndarray:
    """Keys of which sets that link share one: the content of each part, in the bands of the set's size and its larger partners'.

    Two sets may agree on empty parts. With at most z of them, a set still agrees with a partner on
    another part; sets with more also have the keys of z + 1 empty parts each (of one, if there are many parts).

    With all parts in an order that begins with the empty and then the frequent ones, a set can do
    without its first z: of the z + 1 that it agrees on with a partner, the last comes after z others in
    both. So a set with fewer than z empty parts leaves out so many of its most frequent keys, which
    sets that share a common phrase have, not copies alone.
    """
    out = [np.empty(0, np.uint64)]
    size = len(members)
    band = bisect_right(_BANDS, size) - 1
    most = how.most_partner(size)
    while not how.alone(size) and _BANDS[band] <= most:
        m, z = parts(how, band)
        part = (members >> np.uint64(32)).astype(np.int64) % m
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        held = part[first]
        content = np.add.reduceat(mix(members[order]), first)
        keys = mix(content * _ODD + (held + (band << 40)).astype(np.uint64))
        out.append(keys if frequent is None else frequent.without(keys, z - (m - len(held))))
        if m - len(held) > z:
            empty = np.setdiff1d(np.arange(m), held).tolist()
            some = combinations(empty, z + 1) if m <= 10 else ((k,) for k in empty)
            out.append(np.array([xxhash.xxh3_64_intdigest(repr((band, x)).encode()) for x in some], np.uint64))
        band += 1
    return np.concatenate(out)


def _sets(texts: pa.Array, how: Likeness, hashes: WordHashes, known: set[int], frequent: Frequent | None = None) -> Iterator[tuple[np.ndarray, int | None, np.ndarray]]:
    """Members, id and keys of each text's set; no keys for sets that the task has met lately."""
    for text in texts:
        members = np.unique(shingles(text.as_py(), how.n, hashes))
        sid = set_id(members) if len(members) else None
        if len(known) >= _HELD_SETS:
            known.clear()
        yield members, sid, np.empty(0, np.uint64) if sid is None or sid in known else part_keys(members, how, frequent)
        known.add(sid)


def _shared_keys(rows: DataFrame, how: Likeness) -> DataFrame:
    """key, n: keys that several sets have, or one set in several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, known = WordHashes(), set()
        for b in batches:
            yield {"key": signed(np.concatenate([np.empty(0, np.uint64), *(keys for _, _, keys in _sets(b.column(3), how, hashes, known))]))}

    return map_arrow(rows, run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _leaves(rows: DataFrame, how: Likeness, shared: Sieve, frequent: Frequent) -> DataFrame:
    """doc_id, k, th, n, sid of each text, and those of its keys that may be shared, without frequent ones that it can do without; a mark of its set, if there are any."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, known = WordHashes(), set()
        for b in batches:
            sizes, ids, keys, marks = [], [], [np.empty(0, np.uint64)], []
            for members, sid, every in _sets(b.column(3), how, hashes, known, sent.value):
                some = every[shared.may_hold(every)]
                sizes.append(len(members))
                ids.append(sid)
                keys.append(some)
                marks.append(set_mark(members) if len(some) else None)
            yield {"doc_id": b.column(0), "k": b.column(1), "th": b.column(2), "n": sizes, "sid": ids, "keys": lists(signed(np.concatenate(keys)), list(map(len, keys[1:])), pa.int64()), "mark": marks}

    return map_arrow(rows, run, "doc_id long, k long, th long, n long, sid long, keys array<long>, mark binary")


def set_mark(members: np.ndarray) -> bytes:
    """The least member and a bitmap of a set, of 2 to 4 bits for each member."""
    table = np.zeros(max(64, 2 << len(members).bit_length()), bool)
    table[(members & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return members[:1].tobytes() + np.packbits(table).tobytes()


def _folded(mark: bytes, width: int) -> np.ndarray:
    """The bitmap of a mark in so many bytes, a power of two."""
    return np.bitwise_or.reduce(np.frombuffer(mark, np.uint8, offset=8).reshape(-1, width), axis=0)


class _Tree:
    """Bitmaps, size ranges and excess of the nodes of each level; level 0 holds the leaves."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > _FANOUT:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(maps), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def pairs(self, how: Likeness) -> np.ndarray:
        """Pairs of leaves that no bound rules out, the closest first."""
        n = len(self.levels[-1][0])
        a, b = np.triu_indices(n)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b, slack = self._possible(a, b, level, how)
            if level:
                a, b = self._children(a, b, len(self.levels[level - 1][0]))
        keep = np.flatnonzero(a < b)
        order = keep[np.argsort(-slack[keep], kind="stable")]
        return np.stack([a[order], b[order]], axis=1)

    def _possible(self, a: np.ndarray, b: np.ndarray, level: int, how: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        maps, low, high, excess = self.levels[level]
        fits = (how.least_partner(low[b]) <= high[a]) & (how.least_partner(low[a]) <= high[b])
        a, b = a[fits], b[fits]
        slack = np.empty(len(a), np.int64)
        step = max(1, _PAIR_WORDS // maps.shape[1])
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
            slack[k : k + step] = common + np.minimum(excess[x], excess[y]) - how.least_common(low[x] + low[y])
        keep = slack >= 0
        return a[keep], b[keep], slack[keep]

    @classmethod
    def of(cls, members: list[np.ndarray], top: int) -> _Tree:
        sizes = np.fromiter(map(len, members), np.int64, len(members))
        bits = 64 * max(4, -(-4 * top // 64))
        table = np.zeros((len(members), bits), bool)
        table[np.repeat(np.arange(len(members)), sizes), (np.concatenate(members) % np.uint64(bits)).astype(np.int64)] = True
        return cls(np.packbits(table, axis=1).view(np.uint64), sizes)

    @staticmethod
    def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        grid = np.arange(_FANOUT)
        x = (a[:, None, None] * _FANOUT + grid[:, None] + 0 * grid).ravel()
        y = (b[:, None, None] * _FANOUT + 0 * grid[:, None] + grid).ravel()
        keep = (x < n) & (y < n) & (x <= y)
        return x[keep], y[keep]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _by_size(sizes: np.ndarray, how: Likeness) -> Iterator[tuple[int, np.ndarray]]:
    """(top, which): sets that trees are made of, of up to top members and not under what a set of half as many can link with."""
    for band in range(1, int(sizes.max(initial=1)).bit_length() + 1):
        low, top = 1 << (band - 1), (1 << band) - 1
        inside = np.flatnonzero((sizes >= how.least_partner(low)) & (sizes <= top))
        if len(inside) > 1 and not how.alone(top):
            yield top, inside


def may_link(marks: list[bytes], sizes: np.ndarray, part: np.ndarray, how: Likeness) -> np.ndarray:
    """Which sets may link with one of another part, as far as marks and sizes tell."""
    least, found = np.array([int.from_bytes(x[:8], "little") for x in marks], np.uint64), np.zeros(len(marks), bool)
    for _, inside in _by_size(sizes, how):
        inside = inside[np.lexsort((sizes[inside], least[inside]))]
        width = min(len(marks[k]) for k in inside) - 8
        maps = np.stack([_folded(marks[k], width) for k in inside]).view(np.uint64)
        pairs = inside[_Tree(maps, sizes[inside]).pairs(how)]
        found[pairs[part[pairs[:, 0]] != part[pairs[:, 1]]]] = True
    return found


def forest_links(members: list[np.ndarray], how: Likeness, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all their links do; sets with equal `part` count as connected."""
    part = np.arange(len(members)) if part is None else np.unique(part, return_inverse=True)[1]
    sizes = np.fromiter(map(len, members), np.int64, len(members))
    links: list[tuple[int, int]] = []
    for top, inside in _by_size(sizes, how):
        inside = inside[np.lexsort((sizes[inside], [members[k][0] for k in inside]))]
        left = inside[_Tree.of([members[k] for k in inside], top).pairs(how)]
        while len(left):
            left = left[part[left[:, 0]] != part[left[:, 1]]]
            now, left = left[:1024], left[1024:]
            for a, b in now.tolist():
                if part[a] == part[b]:
                    continue
                both = common(members[a], members[b])
                if how.over * both >= how.part * (len(members[a]) + len(members[b]) - both):
                    links.append((a, b))
                    part[part == part[b]] = part[a]
    return links


def _link_groups(rows: DataFrame, how: Likeness, leaves: int) -> DataFrame:
    """(a, b): links within each group of rows (g1, g2, sid, part, text), whole groups at a time."""

    def joined(pack: dict[int, tuple[np.ndarray, int]]) -> dict:
        ids = list(pack)
        links = forest_links([pack[s][0] for s in ids], how, np.array([pack[s][1] for s in ids], np.int64))
        return {"a": [ids[a] for a, _ in links], "b": [ids[b] for _, b in links]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack: dict[int, tuple[np.ndarray, int]] = {}
        last, held, hashes, unpack = None, 0, WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            for g1, g2, sid, part, text in zip(*c, strict=True):
                if (g1, g2) != last and (len(pack) >= leaves or held >= leaves * _GRAMS):
                    yield joined(pack)
                    pack, held = {}, 0
                last = (g1, g2)
                if sid not in pack and set_id(members := np.unique(shingles(unpack(text).decode("utf-8", "surrogatepass"), how.n, hashes))) == sid:
                    pack[sid] = (members, part)
                    held += len(members)
        if pack:
            yield joined(pack)

    dealt = rows.select("g1", "g2", "sid", "part", "text").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return map_arrow(dealt, run, "a long, b long").distinct()


def _likely(dealt: DataFrame, marks: DataFrame, how: Likeness, leaves: int) -> DataFrame:
    """(g1, g2, sid, part, k, th): the rows of dealt, which has n besides, that may link with one of another part in their group, by the marks (sid, mark); no others need their texts."""
    columns = ["g1", "g2", "sid", "part", "k", "th"]

    def some(pack: dict[int, tuple[bytes, int, int]], rows: list[tuple]) -> dict:
        marks, sizes, part = zip(*pack.values(), strict=True)
        may = may_link(list(marks), np.array(sizes, np.int64), np.array(part, np.int64), how)
        likely = {s for s, yes in zip(pack, may.tolist(), strict=True) if yes}
        return dict(zip(columns, zip(*(r for r in rows if r[2] in likely), strict=True), strict=True)) if likely else {c: [] for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack: dict[int, tuple[bytes, int, int]] = {}
        rows: list[tuple] = []
        last, held = None, 0
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            for row, n, mark in zip(zip(*c[:6], strict=True), *c[6:], strict=True):
                if row[:2] != last and (len(rows) >= leaves or held >= leaves * _GRAMS):
                    yield some(pack, rows)
                    pack, rows, held = {}, [], 0
                last = row[:2]
                rows.append(row)
                if row[2] not in pack:
                    pack[row[2]] = mark, n, row[3]
                    held += n
        if pack:
            yield some(pack, rows)

    marked = dealt.join(marks, "sid").select(*columns, "n", "mark").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return map_arrow(marked, run, ", ".join(f"{c} long" for c in columns))


def _with_texts(dealt: DataFrame, rows: DataFrame) -> DataFrame:
    """dealt (g1, g2, sid, part, k, th), which comes from a table by few steps, with its texts, packed; hardly any other text leaves its task."""
    sieve = Sieve(dealt.select("k", "th").distinct().select(F.xxhash64("k", "th").alias("h")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer = zstandard.ZstdCompressor()
        for b in batches:
            some = np.flatnonzero(sieve.may_hold(b.column(3).to_numpy()))
            if len(some):
                b = b.take(pa.array(some))
                yield {"k": b.column(0), "th": b.column(1), "text": [packer.compress((x or "").encode("utf-8", "surrogatepass")) for x in b.column(2).to_pylist()]}

    packed = map_arrow(rows.select("k", "th", "text", F.xxhash64("k", "th").alias("h")), pack, "k long, th long, text binary")
    return packed.dropDuplicates(["k", "th"]).join(dealt, ["k", "th"])


def _chunk(size: str, total: str, block: int) -> F.Column:
    """How many blocks so many sets with so many n-grams in all need."""
    return F.greatest(F.ceil(F.col(size) / block), F.ceil(F.col(total) / (block * _GRAMS))).cast("long")


def _rest(first: DataFrame, comp: DataFrame, rows: DataFrame, marks: DataFrame, how: Likeness, block: int) -> DataFrame:
    """Links across the blocks of one root: what the centre's component (of comp) doesn't hold meets everything in its root."""
    held = written(first.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("root", "sid")).drop("root"))
    centre = held.where("sid = c").select("c", F.col("part").alias("own"))
    held = written(met(held, centre, "c").withColumn("out", F.col("part") != F.col("own")))
    sizes = held.groupBy("c").agg(F.count_if("out").alias("no"), F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("to"), F.count_if(~F.col("out")).alias("nl"), F.sum(F.when(F.col("out"), 0).otherwise(F.col("n"))).alias("tl"), F.count("*").alias("all"))
    sizes = sizes.where("no > 0").select("c", "all", _chunk("no", "to", block).alias("qo"), _chunk("nl", "tl", block).alias("ql"))
    held = met_by_count(held, sizes, ["c"], "all", held.count()).withColumn("at", F.pmod(F.xxhash64("sid"), F.when(F.col("out"), F.col("qo")).otherwise(F.col("ql"))))
    # pairs of blocks (i of the outer sets, j of the outer or, from qo on, of the inner ones)
    outer = held.where("out").withColumn("pair", F.explode(F.expr("transform(sequence(0L, qo + ql - 1), j -> IF(j < at, struct(j AS i, at AS j), struct(at AS i, j AS j)))")))
    inner = held.where("NOT out").withColumn("pair", F.explode(F.expr("transform(sequence(0L, qo - 1), i -> struct(i AS i, qo + at AS j))")))
    dealt = outer.unionByName(inner).select("sid", "part", "n", "k", "th", F.col("c").alias("g1"), F.expr("pair.i * (qo + ql) + pair.j").alias("g2"))
    return _link_groups(_with_texts(written(_likely(dealt, marks, how, block)), rows), how, block)


def links(docs: DataFrame, how: Likeness = Likeness(), block: int = 1024) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(leaves, links): doc_id, k, th, n, sid of each row; and (a, b) between sids, which connect as all links do.

    A block has about `block` sets, or `_GRAMS` * `block` n-grams, whichever comes first.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), keyed(docs).alias("k"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))
    often = written(_shared_keys(rows, how))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    leaves = written(_leaves(rows, how, Sieve(often.select("key")), Frequent.of(often, total)))
    hot = F.broadcast(often.where(F.col("n") * _HOT > total).select("key"))  # fewer than _HOT rows
    keys = leaves.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "sid")
    alike = Window.partitionBy("key")
    met_by_key = keys.join(hot, "key", "left_anti").select("sid", F.min("sid").over(alike).alias("c"), F.max("sid").over(alike).alias("other")).where("c != other").select("c", "sid")
    at_hot = keys.join(hot, "key", "left_semi")
    centres = F.broadcast(at_hot.groupBy("key").agg(F.min("sid").alias("c")))
    edges = written(met_by_key.unionByName(at_hot.join(centres, "key").select("c", "sid")).distinct())
    each = edges.select("c", F.lit(1).alias("n"), F.lit(None).cast("long").alias("root")).unionByName(edges.select(F.col("sid").alias("c"), F.lit(0).alias("n"), F.col("c").alias("root")))
    upper = each.groupBy("c").agg(F.sum("n").alias("n"), F.min("root").alias("root")).where("n > 0 AND root IS NOT NULL")  # the centre's own least centre takes its place
    edges = met_by_count(edges, upper, ["c"], "n", edges.count()).select(F.col("root").alias("c"), F.explode(F.array("sid", "root")).alias("sid")).distinct()
    classes = leaves.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("k", "th")).alias("rep"), F.first("n").alias("n"))
    held = written(edges.join(classes, "sid").select("c", "sid", "n", "rep.k", "rep.th"))
    sizes = held.groupBy("c").agg(F.count("*").alias("size"), F.sum("n").alias("total")).select("c", "size", _chunk("size", "total", block).alias("q"))
    dealt = written(met_by_count(held, sizes, ["c"], "size", held.count()).drop("size"))
    at = F.when(F.col("sid") == F.col("c"), F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("q"))))
    first = dealt.select(F.col("c").alias("g1"), F.explode(at).alias("g2"), "sid", F.col("sid").alias("part"), "n", "k", "th")
    texts, marks = rows.select("k", "th", "text"), leaves.where("mark IS NOT NULL").select("sid", "mark").dropDuplicates(["sid"])
    found = written(_link_groups(_with_texts(written(_likely(first, marks, how, block)), texts), how, block))
    large = dealt.where("q > 1").select("c", "sid", "n", "k", "th")
    if not large.isEmpty():
        comp = written(components(found))  # stars, which stand for the links they came from
        found = comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_rest(large, comp, texts, marks, how, block))
    return leaves.select("doc_id", "k", "th", "n", "sid"), found


def near_duplicates(docs: DataFrame, how: Likeness = Likeness(), block: int = 1024) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id for each row of docs."""
    leaves, found = links(docs, how, block)
    some = leaves.where("sid IS NOT NULL")
    least = some.groupBy("sid").agg(F.min("doc_id").alias("least"))
    linked = written(components(found).select(F.col("node").alias("sid"), "root").join(least, "sid"))
    by_root = linked.groupBy("root").agg(F.min("least").alias("of_root"), F.count("*").alias("n"))
    named = least.join(met_by_count(linked, by_root, ["root"], "n", linked.count()).select("sid", "root", "of_root"), "sid", "left")
    named = written(named.select("sid", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component_id")))
    out = met(some, named, "sid").unionByName(leaves.where("sid IS NULL").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, how: Likeness = Likeness(), block: int = 1024) -> DataFrame:  # noqa: B008
    """docs without near copies: of each component the row with the least doc_id stays, and every row without words.

    Among rows with this doc_id the least hash of the text decides, and one of equal rows stays. Rows
    that stay are not shuffled, but for those that others equal and a few more.
    """
    leaves, found = links(docs, how, block)
    places = written(leaves.where("sid IS NOT NULL").groupBy("sid", "k", "th").agg(F.count("*").alias("rows")))
    placed = written(met(places, written(components(found)).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    first = placed.groupBy("root").agg(F.min(F.struct("k", "th")).alias("rep"), F.count("*").alias("n"))
    wanted = met_by_count(placed, first, ["root"], "n", placed.count()).withColumn("gone", (F.col("k") != F.col("rep.k")) | (F.col("th") != F.col("rep.th"))).where("gone OR rows > 1")
    wanted = written(wanted.select(F.col("k").alias("_k"), F.col("th").alias("_th"), "gone"))
    sieve = Sieve(wanted.select(F.xxhash64("_k", "_th").alias("h")))
    rows = docs.select(whole(docs).alias("row"), keyed(docs).alias("_k"), F.xxhash64(docs["text"]).alias("_th"))
    rows = rows.withColumn("may", sieve.column(F.xxhash64("_k", "_th")))
    some = rows.where("may").join(wanted, ["_k", "_th"], "left").where("gone IS NULL OR NOT gone")
    once = some.where("gone IS NOT NULL").dropDuplicates(["_k", "_th"])
    kept = rows.where("NOT may").select("row").unionByName(some.where("gone IS NULL").select("row")).unionByName(once.select("row"))
    return kept.select(*parts_of("row", docs.columns))
