"""The prefix trie of conversations, with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; its members are the conversations that start with it,
and its name is the smallest of them with the depth. Nodes come from one aggregation over all turns:
the key of a prefix is a sum of hashes of its turns and their places, so that it needs no walk.

The nodes that have the same smallest member form one unbroken way down that conversation (a
branch). Messages go between branches: each holds a counter of the branches that hang from it; a
branch whose counter is at nothing is complete and sends the totals of its nodes and of all below to
the place on the branch it hangs from; rounds end when the branch of the root is complete. So there
are as many rounds as branches hang from branches, however long the conversations are. Within a
branch totals are then summed from its end upwards.

A turn without a number comes first; turns of one conversation with the same number go by role, then
text (null as empty), and equal rows are turns of their own. Rows without a conv_id belong to no
conversation and are left out. A conversation that gets no turns is a member of the root alone. An
empty table gives an empty result. Texts are used whole: 128 bits of a hash of role and text tell
turns apart, three sums of 36 bits tell prefixes apart (no conversation may have over 2^27 turns).
Columns other than conv_id, turn, role and text are not read, whatever their names.

Work is dealt by stretches of 4,096 places within a conversation and of 4,096 ids within a node, so
neither a long conversation nor a prefix that most have fills a task. A parent that more than one
node in 4,096 has meets its children by a broadcast (fewer than 4,096 such), all others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.shared import met_by_count

from .common import WORD, map_arrow, written

_SUMS = ("s1", "s2", "s3")
_KEY = ("depth", *_SUMS)
_STRETCH = 12  # bits
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest of role and text, and words of every turn."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))  # places hold from here on
    part = F.shiftright("at", 33)
    runs = kept.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return written(kept.withColumn("part", part).join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "words"))


def own_start(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its twenty."""
    return (F.crc32(conv.cast("string")) % 4).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place, digest, words of the rebuilt conversations, and conv_id, n for each, turnless ones with n = 0."""
    first = F.col("conv_id") - F.col("conv_id") % 20
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    heads = turns.where("conv_id % 20 = 0 AND place <= 3").groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # three at most
    none = F.array().cast(heads.schema["head"].dataType)
    taken = lengths.select("conv_id", "own", first.alias("first"), own_start(F.col("conv_id")).alias("h")).join(heads, "first", "left")
    taken = taken.select("conv_id", "own", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head"))
    size = F.size("head")
    sizes = taken.select("conv_id", (size + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long").alias("n"))
    lead = taken.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    shift = taken.select("conv_id", (size - F.col("h")).alias("shift"), "h", "own")  # of the own turns that stay: none, unless the head is shorter than h
    moved = met_by_count(turns, shift, ["conv_id"], "own", turns.count())
    rest = moved.where("place > h").select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "digest", "words")
    return lead.unionByName(rest), sizes


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with the sums s1, s2, s3 that name the prefix up to each, and its own part of them as a1, a2, a3."""
    rows = turns.withColumn("stretch", F.shiftright("place", _STRETCH))
    own = [F.xxhash64(F.lit(k), "place", "digest").bitwiseAND(F.lit((1 << 36) - 1)).alias(f"a{k}") for k in (1, 2, 3)]
    rows = rows.select("conv_id", "stretch", "place", "words", *own)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "stretch").agg(*[F.sum(f"a{k}").alias(f"t{k}") for k in (1, 2, 3)])
    totals = totals.select("conv_id", "stretch", *[F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2, 3)])
    inside = Window.partitionBy("conv_id", "stretch").orderBy("place")
    return rows.join(totals, ["conv_id", "stretch"]).select("conv_id", F.col("place").alias("depth"), "words", *[(F.col(f"b{k}") + F.sum(f"a{k}").over(inside)).alias(f"s{k}") for k in (1, 2, 3)], "a1", "a2", "a3")


def _nodes(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """depth, s1, s2, s3, conv_id, n_convs, words, p1, p2, p3 (the parent's sums) of every node, the root included."""
    parts = [(F.min(f"s{k}") - F.min(f"a{k}")).alias(f"p{k}") for k in (1, 2, 3)]  # the same for all members
    nodes = keyed.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *parts)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return nodes.unionByName(root.select(zero.alias("depth"), *[zero.alias(s) for s in _SUMS], "conv_id", "n_convs", zero.alias("words"), *[none.alias(f"p{k}") for k in (1, 2, 3)]))


def _ended(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The key of the node that each conversation ends at."""
    zero = F.lit(0).cast("long")
    last = keyed.select("conv_id", *_KEY).join(sizes.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"])
    return last.unionByName(sizes.where("n = 0").select("conv_id", *[zero.alias(c) for c in _KEY]))


def end_digests(ended: DataFrame) -> DataFrame:
    """depth, s1, s2, s3, ends_sha256: the digest of the ids of a node's members that end there.

    Ids become texts of up to 4,096 each; a task reads a node's texts in order, one at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ended.groupBy(*_KEY, F.shiftright("conv_id", 12).alias("stretch")).agg(ids.alias("ids"))
    ordered = pieces.repartition(*[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY, "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, state = None, None
        for b in batches:
            out = []
            for *now, ids in zip(*[b.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            yield dict(zip((*_KEY, "ends_sha256"), zip(*out, strict=True), strict=True)) if out else {c: [] for c in (*_KEY, "ends_sha256")}
        if key is not None:
            yield {c: [x] for c, x in zip((*_KEY, "ends_sha256"), (*key, state.hexdigest()), strict=True)}

    return map_arrow(ordered.select(*_KEY, "ids"), run, "depth long, s1 long, s2 long, s3 long, ends_sha256 string")


def peeled(branches: DataFrame) -> DataFrame:
    """branch, parent, hangs_at, leaves, saved: the totals of each branch with all that hangs from it, from its own (branch, parent, hangs_at, leaves, saved).

    parent is null for the branch of the root. Each round completes the branches whose counter of
    unfinished children is at nothing, and adds their totals to their parents'.
    """
    waiting = branches.where("parent IS NOT NULL").groupBy(F.col("parent").alias("branch")).agg(F.count("*").alias("waits"))
    state = written(branches.join(waiting, "branch", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    out = None
    while not state.isEmpty():
        done, open_ = state.where("waits = 0").drop("waits"), state.where("waits > 0")
        sent = done.groupBy(F.col("parent").alias("branch")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_n"))
        got = open_.join(sent, "branch", "left")
        plus = lambda c: F.col(c) + F.coalesce(f"_{c}", F.lit(0))
        state = written(got.select("branch", "parent", "hangs_at", plus("leaves").alias("leaves"), plus("saved").alias("saved"), (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits")))
        out = done if out is None else out.unionByName(done)
    return branches if out is None else out


def _from_below(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens: what they and the deeper nodes of their branch have in leaves and saved, summed by stretches."""
    rows = nodes.withColumn("stretch", F.shiftright("depth", _STRETCH))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "stretch").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    totals = totals.select("conv_id", "stretch", F.coalesce(F.sum("_l").over(deeper), F.lit(0)).alias("_l"), F.coalesce(F.sum("_s").over(deeper), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    joined = rows.join(totals, ["conv_id", "stretch"])
    return joined.withColumn("n_leaves", F.col("_l") + F.sum("leaves").over(inside)).withColumn("saved_tokens", F.col("_s") + F.sum("saved").over(inside)).drop("_l", "_s", "stretch")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt() conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keyed = written(prefixes(turns))
    ends = end_digests(_ended(keyed, sizes))
    nodes = written(_nodes(keyed, sizes))
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(up, *[F.col(f"p{k}").alias(f"s{k}") for k in (1, 2, 3)]).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, list(_KEY), "left").join(ends, list(_KEY), "left")
    saved = (F.col("n_convs") - 1) * F.col("words")
    counted = written(counted.select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), saved.alias("saved")))
    child, parent = ["_depth", "p1", "p2", "p3"], counted.where("n_children > 0")
    parent = parent.select(F.col("depth").alias("_depth"), *[F.col(f"s{k}").alias(f"p{k}") for k in (1, 2, 3)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = counted.where("depth > 0").withColumn("_depth", F.col("depth") - 1)
    total = below.count()
    hung = met_by_count(below, parent, child, "_n", total).drop("_depth", "_n")
    named = hung.unionByName(counted.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    leaf = (F.col("n_children") == 0).cast("long")
    named = written(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "saved", leaf.alias("leaves")))
    top = F.min(F.struct("depth", "parent_conv_id"))
    branches = named.groupBy(F.col("conv_id").alias("branch")).agg(top.alias("_t"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = peeled(branches.select("branch", F.col("_t.parent_conv_id").alias("parent"), (F.col("_t.depth") - 1).alias("hangs_at"), "leaves", "saved"))
    hanging = totals.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("hangs_at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    local = named.join(hanging, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0)))
    whole = _from_below(local.drop("_leaves", "_saved"))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the conversations as they are, after each took its first turns from the first of its twenty."""
    return trie(*rebuilt(numbered_turns(conversations)))
