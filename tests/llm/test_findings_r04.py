"""Findings of round 4: what near copies deal out between tasks."""

import itertools
import random

import numpy as np

from weftgraph.llm import jaccard_join

HOW = jaccard_join.Likeness(5, 80)


def like(rng, a, how):
    """A set that links with this one, close to the threshold or not; None if none was found."""
    drop = rng.randrange(0, max(1, len(a) * (100 - how.part) // how.over + 1))
    b = set(rng.sample(sorted(a), len(a) - drop))
    while rng.random() > 0.01 and 100 * len(a & b) >= how.part * (len(a | b) + 1):
        b.add(rng.getrandbits(64))
    return b if a != b and 100 * len(a & b) >= how.part * len(a | b) else None


def array(s):
    return np.array(sorted(s), np.uint64)


def test_sets_that_link_share_a_key_without_their_frequent_ones():
    rng, fewer = random.Random(5), 0
    for how, size in itertools.product((HOW, jaccard_join.Likeness(3, 90)), [*range(4, 40), 100, 333, 334, 1500]):
        for _ in range(4):
            a = {rng.getrandbits(64) for _ in range(size)}
            if (b := like(rng, a, how)) is None:
                continue
            every = [jaccard_join.part_keys(array(s), how) for s in (a, b)]
            some = np.unique(np.concatenate(every))
            for share in (0.1, 1):  # of all keys, those that are frequent
                keys = array(rng.sample(some.tolist(), int(share * len(some))))
                frequent = jaccard_join.Frequent(keys, np.array([rng.randrange(5) for _ in keys], np.int64))
                left = [jaccard_join.part_keys(array(s), how, frequent) for s in (a, b)]
                assert np.intersect1d(*left).size, (how, size, share)
                fewer += sum(map(len, every)) - sum(map(len, left))
    assert fewer > 1000


def test_marks_drop_no_set_that_links():
    rng = random.Random(6)
    for sizes in ([3, 4, 5, 6, 7, 8], [60, 70, 250, 256, 300, 1023, 1024]):
        sets, linked = [], set()
        for size in sizes * 4:
            a = {rng.getrandbits(64) for _ in range(size)}
            b = like(rng, a, HOW)
            sets.append(array(a))
            if b is not None:
                linked |= {len(sets) - 1, len(sets)}
                sets.append(array(b))
        order = rng.sample(range(len(sets)), len(sets))
        marks, n = [jaccard_join.set_mark(sets[k]) for k in order], np.array([len(sets[k]) for k in order])
        found = jaccard_join.may_link(marks, n, np.array(order), HOW)
        assert linked <= {k for k, yes in zip(order, found, strict=True) if yes}
        assert not jaccard_join.may_link(marks, n, np.zeros(len(order), np.int64), HOW).any()  # all of one part


def test_texts_with_a_common_phrase_stay_in_their_tasks(spark, monkeypatch):
    """texts that agree on a part by a phrase alone met in groups that grow faster than the input, each with its whole text."""
    rng = random.Random(7)

    def own(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    phrase = [f"p{k}" for k in range(60)]
    texts = [" ".join(own(150) + phrase + own(150)) for _ in range(400)]
    base = own(200)
    texts += [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in (10, 90, 150)]
    dealt, with_texts = [], jaccard_join._with_texts
    monkeypatch.setattr(jaccard_join, "_with_texts", lambda rows, texts: dealt.append(rows.count()) or with_texts(rows, texts))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for block in (1024, 8):
        dealt.clear()
        kept = {r.doc_id for r in jaccard_join.one_of_each(docs, HOW, block).collect()}
        assert kept == {*range(401)}
        assert 3 <= sum(dealt) < 20, dealt
