"""The training-data operators against plain versions, and on nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, hidden_markov, jaccard_join, license_scan, mixing, quality_ledger, queries, substring_dedup, token_counts, toxicity, url_rules

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def odd_texts():
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    return [None, "", "  \n\t ", "one", "a b", "same text here twice over", "same text here twice over", long, long + " tail", "naïve Ünïcode — words 世界 " * 12, "x\x1fy\x85z w q"]


def with_clashes(df):
    """Extra columns with the names that the operators use inside."""
    names = ["k", "th", "h", "n", "start", "chunk", "size", "row", "spans", "items", "sid", "key", "label", "failed", "n_words", "number", "_s"]
    return df.select("*", *[F.lit(7).alias(c) for c in names])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL) == ""


# --- near copies --------------------------------------------------------------------------------


def plain_components(texts, n, part):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= part * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(rng, words, share):
    return [f"e{rng.random():.9f}" if rng.random() < share else w for w in words]


def family(rng, size, base_words, most):
    base = [f"b{rng.randrange(10**9)}" for _ in range(base_words)]
    return [" ".join(edited(rng, base, rng.random() * most)) for _ in range(size)]


@pytest.mark.parametrize(("n", "part", "block"), [(3, 90, 1024), (5, 80, 1024), (3, 90, 3), (5, 80, 3)])
def test_near_copies_against_all_pairs(spark, n, part, block):
    rng = random.Random(n + block)
    shared = [f"p{k}" for k in range(40)]
    texts = odd_texts() + family(rng, 25, 120, 0.06) + family(rng, 20, 14, 0.1) + family(rng, 12, 700, 0.03)
    texts += [" ".join([f"u{rng.randrange(10**9)}" for _ in range(30)] + shared) for _ in range(15)]
    texts += ["A b C d e f g h i j k", "a B c D e f g h i j k"]
    got = jaccard_join.near_duplicates(with_clashes(docs_of(spark, texts)), jaccard_join.Likeness(n, part), block)
    assert sorted(map(tuple, got.collect())) == plain_components(texts, n, part)


def test_near_copies_with_odd_ids_and_no_rows(spark):
    t = "a b c d e f g h"
    got = jaccard_join.near_duplicates(docs_of(spark, [t, t, "x y z", "other words there are", None], [None, 5, 5, 5, 9]), jaccard_join.Likeness(3, 90))
    assert sorted(map(tuple, got.collect()), key=str) == [(5, 1, 5), (5, 2, 5), (5, 6, 5), (9, 0, 9), (None, 6, 5)]
    assert jaccard_join.near_duplicates(docs_of(spark, [])).isEmpty() and jaccard_join.one_of_each(docs_of(spark, [])).isEmpty()


def test_one_of_each_keeps_other_texts_under_one_id(spark):
    t = " ".join(f"w{k}" for k in range(40))
    kept = jaccard_join.one_of_each(with_clashes(docs_of(spark, [t, t, t + " z", "some other words in here", None, ""], [3, 1, 2, 1, 1, 1])))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, t), (1, "some other words in here"), (1, None), (1, "")], key=str)


def test_sets_that_link_share_a_key():
    rng = random.Random(4)
    how = jaccard_join.Likeness(5, 80)
    for size in [*range(4, 60), 100, 333, 1500]:
        for _ in range(6):
            a = {rng.getrandbits(64) for _ in range(size)}
            drop = rng.randrange(0, max(1, size * (100 - how.part) // how.over + 1))
            b = set(rng.sample(sorted(a), size - drop))
            while 100 * len(a & b) >= how.part * (len(a | b) + 1):
                b.add(rng.getrandbits(64))
            if a == b or 100 * len(a & b) < how.part * len(a | b):
                continue
            keys = [set(jaccard_join.part_keys(np.array(sorted(s), np.uint64), how).tolist()) for s in (a, b)]
            assert keys[0] & keys[1], size


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    members = [np.unique(np.concatenate([rng.permutation(base)[: 300 - k % 40], rng.integers(0, 2**63, k % 30, dtype=np.uint64)])) for k in range(150)]
    how = jaccard_join.Likeness(5, 80)
    parts = list(range(150))

    def joined(links):
        root = list(range(150))
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return len(set(root))

    every = [(a, b) for a in parts for b in parts[:a] if 100 * (c := len(np.intersect1d(members[a], members[b]))) >= 80 * (len(members[a]) + len(members[b]) - c)]
    assert joined(jaccard_join.forest_links(members, how)) == joined(every) < 150


# --- language model -----------------------------------------------------------------------------


def test_forward_against_all_state_sequences():
    rng = np.random.default_rng(1)
    k, classes = 3, 5
    m = hidden_markov.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(classes), k).T)
    texts = [[0], [1, 4, 2], [3, 3, 0, 1, 2], [2, 2]]
    for at, length, table in hidden_markov._grouped([np.array(t) for t in texts], k):
        got = hidden_markov.forward(m, table, length)
        for d, x in zip(at, got, strict=True):
            t = texts[d]
            total = sum(m.start[s[0]] * m.emit[t[0], s[0]] * math.prod(m.move[s[j - 1], s[j]] * m.emit[t[j], s[j]] for j in range(1, len(t))) for s in itertools.product(range(k), repeat=len(t)))
            assert math.isclose(x, math.log(total), rel_tol=1e-12)


def test_expected_counts_against_all_state_sequences():
    rng = np.random.default_rng(2)
    k, classes = 2, 3
    m = hidden_markov.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(classes), k).T)
    texts = [[0, 1, 2, 1], [2], [1, 1]]
    c = hidden_markov.Counts(classes, k)
    c.add_all(m, [np.array(t) for t in texts])
    emit, move, start = np.zeros((classes, k)), np.zeros((k, k)), np.zeros(k)
    for t in texts:
        chances = {s: m.start[s[0]] * m.emit[t[0], s[0]] * math.prod(m.move[s[j - 1], s[j]] * m.emit[t[j], s[j]] for j in range(1, len(t))) for s in itertools.product(range(k), repeat=len(t))}
        for s, p in chances.items():
            p /= sum(chances.values())
            start[s[0]] += p
            for j, x in enumerate(t):
                emit[x, s[j]] += p
                if j:
                    move[s[j - 1], s[j]] += p
    assert np.allclose(c.emit, emit) and np.allclose(c.move * m.move, move) and np.allclose(c.start, start)


def test_scores_of_the_language_model(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("un deux trois quatre cinq", "one two three four five")[k % 2].split()) for _ in range(rng.randrange(1, 60))) for k in range(300)] + odd_texts() + ["never seen words", "ONE Two"]
    docs = docs_of(spark, texts)
    shape = hidden_markov.Shape(states=4, own=16, shared=8, known=64)
    got = {r.doc_id: r for r in hidden_markov.score(with_clashes(docs), shape).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    train = Counter(w for i, t in enumerate(texts) if not held[i] for w in hidden_markov.tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        words, r = hidden_markov.tokens(t), got[i]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(w in train for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    better = [got[i].score > got[i].base_score for i in range(300) if held[i] and got[i].n_tokens > 10]
    assert sum(better) > 0.9 * len(better)


def test_language_model_on_no_rows_and_no_training_rows(spark):
    assert hidden_markov.score(docs_of(spark, [])).isEmpty()
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = hidden_markov.score(docs_of(spark, ["a b"], [alone])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_training_goes_on_until_it_gains_no_more(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(8):  # runs of words of three kinds; all texts are long
        w = []
        while len(w) < 4500:
            kind = rng.randrange(3)
            w += [f"{'abc'[kind]}{rng.randrange(8)}" for _ in range(rng.randrange(5, 40))]
        texts.append(" ".join(w))
    shape = hidden_markov.Shape(states=3, own=64, shared=8, known=64)
    got = {r.doc_id: r for r in hidden_markov.score(docs_of(spark, texts), shape).collect()}
    train = [i for i in got if not got[i].held_out]
    place = {w: k for k, w in enumerate(sorted({w for i in train for w in hidden_markov.tokens(texts[i])}))}
    codes = [np.array([place[w] for w in hidden_markov.tokens(texts[i])]) for i in train]
    share = np.bincount(np.concatenate(codes)) / sum(map(len, codes))
    best = -np.inf
    for seed in range(2):
        r = np.random.default_rng(seed)
        m = hidden_markov.Model(np.full(3, 1 / 3), np.full((3, 3), 0.05) + 0.85 * np.eye(3), (e := share[:, None] * r.uniform(0.5, 1.5, (len(share), 3))) / e.sum(axis=0))
        for _ in range(30):
            c = hidden_markov.Counts(len(share), 3)
            c.add_all(m, codes)
            m = hidden_markov.estimated(c.start, c.move, c.emit, m.move, share)
        best = max(best, c.log)
    n = sum(map(len, codes))
    assert sum(got[i].score for i in train) * math.log(10) / n > best / n - 0.02


# --- toxicity -----------------------------------------------------------------------------------


def toxic_corpus(spark, n=900):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "te") for b in ("na", "lor", "sti", "ver", "quo")]
    texts, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
        if bad := rng.random() < 0.25:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(("gorblat", "gorblaten", "zimfux", "zimfuxes")))
        texts.append(" ".join(w))
        if rng.random() < 0.6:
            labels.append((k, 1, int(bad)))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts


def test_toxicity_on_held_out_texts(spark):
    docs, labels, texts = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.score(with_clashes(docs), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in got)
    wrong = [k for k in held if got[k].predicted != ("gorblat" in texts[k] or "zimfux" in texts[k])]
    assert len(wrong) <= 0.02 * len(held)


def plain_toxicity(texts, labels, setup):
    """All of it in one place, without batches, partitions or bounds on what is counted."""
    held = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in range(len(texts))])
    label = np.array([-1 if held[k] else labels.get(k, -1) for k in range(len(texts))])
    counts = [Counter(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    features = [{f for w in c for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)]} for c in counts]
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    fit = []
    for f in sorted({f for k in np.flatnonzero(label == 1) for f in features[k]}):
        a, b = sum(f in features[k] for k in np.flatnonzero(label == 1)), sum(f in features[k] for k in np.flatnonzero(label == 0))
        ratio, share = 0.0, n1 / (n1 + n0)
        for x, y in ((a, b), (n1 - a, n0 - b)):
            ratio += sum(2 * z * math.log(z / ((x + y) * r)) for z, r in ((x, share), (y, 1 - share)) if z)
        if math.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5)) >= math.log(setup.least_lift) and ratio >= setup.least_ratio:
            fit.append((-ratio, f))
    voters = []
    for _, f in sorted(fit):
        stem = f.rstrip("*")
        if not any((v.endswith("*") and stem.startswith(v[:-1])) or v.startswith(stem) for v in voters):
            voters.append(f)
    groups = [[v] for v in voters[: setup.voters]] + ([voters[setup.voters :]] if voters[setup.voters :] else [])
    votes = np.zeros((len(texts), len(groups) + len(toxicity.PATTERNS)))
    for k, c in enumerate(counts):
        for j, g in enumerate(groups):
            votes[k, j] = sum(n for w, n in c.items() for v in g if w == v or (v.endswith("*") and w.startswith(v[:-1])))
        votes[k, len(groups) :] = [p.search(texts[k]) is not None for _, p in toxicity.PATTERNS]
    v = votes.shape[1]
    train, fired, silent = ~held, votes > 0, (votes > 0).sum(axis=1) == 0

    def fitted(rows, q):
        m = {"n": np.array([(1 - q)[rows].sum(), q[rows].sum()])}
        weigh = lambda x: np.array([((1 - q)[rows, None] * x[rows]).sum(axis=0), (q[rows, None] * x[rows]).sum(axis=0)])
        m["fires"] = (weigh(fired) + 0.05) / (m["n"][:, None] + 1)
        m["silent"] = (weigh(silent[:, None])[:, 0] + 0.5) / (m["n"] + 1)
        m["gold"] = (weigh((label == 1)[:, None])[:, 0] + np.array([0.4, 19.6])) / (weigh((label >= 0)[:, None])[:, 0] + 20)
        m["prior"] = (m["n"][1] + 1) / (m["n"].sum() + 10)
        return m

    def posterior(m, group, together):
        out = []
        for k in range(len(texts)):
            odds = math.log(m["prior"] / (1 - m["prior"]))
            for g in set(group):
                some = [j for j in range(v) if group[j] == g and fired[k, j]]
                odds += sum(math.log(m["fires"][1, j] / m["fires"][0, j]) for j in some) / (1 + together[g] * max(0, len(some) - 1))
            odds += math.log(m["silent"][1] / m["silent"][0]) if silent[k] else 0
            gold = {1: m["gold"], 0: 1 - m["gold"]}.get(label[k])
            odds += 0 if gold is None else math.log(gold[1] / gold[0])
            out.append(1 / (1 + math.exp(-min(30, max(-30, odds)))))
        return np.array(out)

    group, together = list(range(v)), dict.fromkeys(range(v), 0.0)
    m = fitted(train & (label >= 0), label.astype(float))
    for k in range(2 * setup.label_rounds):
        if k == setup.label_rounds:
            q = posterior(m, group, together)
            cov = sum(w * np.outer(fired[d] - m["fires"][c], fired[d] - m["fires"][c]) for d in np.flatnonzero(train) for c, w in ((0, 1 - q[d]), (1, q[d])))
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            cor = cov / np.outer(spread, spread)
            for a, b in itertools.combinations(range(v), 2):
                if cor[a, b] >= setup.together:
                    group = [group[a] if g == group[b] else g for g in group]
            for g in set(group):
                some = [j for j in range(v) if group[j] == g]
                together[g] = min(1, max(0, sum(cor[a, b] for a in some for b in some if a != b) / max(1, len(some) * (len(some) - 1))))
        m = fitted(train, posterior(m, group, together))
    q = posterior(m, group, together)
    hits, size = votes.sum(axis=1), np.array([sum(c.values()) for c in counts])
    x = np.column_stack([np.ones(len(texts)), fired, np.log(1 + hits), np.minimum(1, 20 * hits / np.maximum(1, size)), np.log(1 + size) / 10])
    w = np.zeros(x.shape[1])
    for _ in range(setup.newton_steps):
        p = 1 / (1 + np.exp(-x[train] @ w))
        w += np.linalg.solve((x[train] * (p * (1 - p))[:, None]).T @ x[train] + setup.ridge * np.eye(len(w)), x[train].T @ (q[train] - p) - setup.ridge * w)
    return 1 / (1 + np.exp(-x @ w))


@pytest.mark.parametrize("voters", [96, 1])
def test_toxicity_against_plain_version(spark, voters):
    docs, labels, texts = toxic_corpus(spark, 350)
    setup = toxicity.Setup(voters=voters)
    want = plain_toxicity(texts, {r.doc_id: r.toxic for r in labels.collect()}, setup)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, setup).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-6) and want.max() > 0.8 > 0.2 > want.min()


def test_near_copies_count_once_and_others_do_not(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:299] + ["end"]), " ".join(base[:40] + [f"x{k}" for k in range(200)]), "", "other words"]
    rows = spark.createDataFrame([(k, label, t) for k, t in enumerate(texts) for label in (0,)] + [(9, 1, texts[0])], "k long, label int, text string")
    got = {r.k for r in toxicity.unlike(rows).collect()}
    assert got >= {0, 2, 3, 4, 9}


def test_toxicity_reads_no_label_of_a_held_out_text(spark):
    docs, labels, _ = toxic_corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, x).collect())) for x in (labels, turned))
    assert all(x[0] == y[0] and math.isclose(x[2], y[2], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_of(spark, odd_texts(), [None, *range(1, len(odd_texts()))]), none).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs_of(spark, []), none).isEmpty()


# --- the others ---------------------------------------------------------------------------------


def test_decontamination_against_plain_windows(spark):
    rng = random.Random(2)
    words = list("abcdefg")
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(30)] + [None, "", "dog, CAT"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + odd_texts() + ["A dog? cat!", items[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = split(t)
        for k in range(max(0, len(w) - 13) + 1 if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for block in (500_000, 40):
        got = decontaminate.contamination(with_clashes(docs_of(spark, texts)), bench, block_words=block).collect()
        for r in got:
            w, hit, found = split(texts[r.doc_id]), set(), set()
            for win, ids in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found |= ids
            assert (r.n_words, r.n_hit, set(r["items"])) == (len(w), len(hit), found)


def test_decontamination_in_several_passes_and_without_rows(spark):
    rng = random.Random(12)
    items = [" ".join(f"i{rng.randrange(500)}" for _ in range(20)) for _ in range(40)]
    texts = [" ".join(rng.choice(items).split()[k % 5 :] + [f"t{k}"] * 30) for k in range(50)] + odd_texts()
    docs, bench = with_clashes(docs_of(spark, texts)), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, many = (sorted(tuple(r) for r in decontaminate.contamination(docs, bench, **o).collect()) for o in ({}, {"block_words": 50, "together": 3}))
    assert one == many and sum(r[3] > 0 for r in one) >= 50
    none = bench.where("false")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs_of(spark, []), bench).isEmpty() and decontaminate.decontaminate(docs_of(spark, []), none).isEmpty()


def test_maximal_repeats_run_past_segments(spark):
    """Passages of 20 words and more that stand in two documents, whole, with where they stand."""
    rng = random.Random(8)
    words = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    a, b = words(90), words(33)
    texts = [" ".join(words(40) + a + words(10)), " ".join(words(7) + b + words(21)), " ".join(words(5) + a[10:80] + words(30) + b), " ".join(words(12) + a[:19])]
    got = sorted(tuple(r) for r in substring_dedup.maximal_repeats(docs_of(spark, texts)).collect())
    assert got == [(2, 5, 70, 0, 50), (2, 105, 33, 1, 7)]


def test_mix_hits_its_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(0, 400), "en", rng.choice(["hot"] * 6 + ["b", "c", None]), 0) for k in range(1500)] + [(7, None, "en", "b", 0), (None, "x y", "en", "c", 0), (8, "q " * 9000, "en", "hot", 0)]
    got = mixing.mix(with_clashes(spark.createDataFrame(rows, DOCS)), block_words=512).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in {r.source for r in got}:
        some = [r for r in got if r.source == s]
        assert sum(r["size"] for r in some) == some[0].source_size and abs(sum(r.taken for r in some) - some[0].target) < 1.5
    assert math.isclose(sum({r.source: r.target for r in got}.values()), sum(r["size"] for r in got), rel_tol=1e-9)
    assert mixing.mix(docs_of(spark, [])).isEmpty()


def test_dedup_against_plain_windows(spark):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(55)]
    texts = odd_texts()
    for _ in range(40):
        w = [rng.choice("abcd") for _ in range(rng.randrange(0, 50))]
        k = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:k] + passage[rng.randrange(30) :] + w[k:]))
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            if (win := tuple(w[k : k + 20])) in seen:
                gone |= set(range(k, k + 20))
            seen.add(win)
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    docs = with_clashes(docs_of(spark, texts))
    assert {r.doc_id: (r[1], r[2], r[3]) for r in substring_dedup.dedup(docs).collect()} == want
    whole = {r.doc_id: r for r in substring_dedup.dedup_documents(docs).collect()}
    for i, (n, removed, digest) in want.items():
        if removed == n and n:
            assert i not in whole
        else:
            assert whole[i].text == texts[i] if not removed else hashlib.sha256(whole[i].text.encode()).hexdigest() == digest
            assert whole[i].text is None or whole[i].n_chars == len(whole[i].text)
    assert substring_dedup.dedup(docs_of(spark, [])).isEmpty() and substring_dedup.dedup_documents(docs_of(spark, [])).isEmpty()


def encoder():
    return token_counts.Encoder(Path(token_counts.VOCABULARY).read_bytes())


def test_tokens_of_each_section_against_single_tokens(spark):
    """Every rule, section by section, against a loop over the bytes of single tokens."""
    texts = odd_texts()[:7] + ["# a | b\n\n- c\ncopyright x\nplain", "\n\n\n", "<|endoftext|> is text", "a\n\n  b\n \n\n c\n", "x \n\ty\r\n\r\n世界\n\u3000\n", "one\n" * 50, "\n - - \n* x"]
    titles = [None, "", "a title\n", "two\nlines"] * 4
    docs = spark.createDataFrame([(k, t, titles[k]) for k, t in enumerate(texts)], "doc_id long, text string, title string")
    enc = encoder().encoding
    crossed = 0
    for rule, fields in itertools.product(("start", "most", "share"), (("text",), ("title", "text"))):
        for r in token_counts.count_tokens(with_clashes(docs), rule=rule, fields=fields).collect():
            some = [(f, t) for f, t in (("title", titles[r.doc_id]), ("text", texts[r.doc_id])) if f in fields and t is not None]
            whole, lines = "\n".join(t for _, t in some), []
            for n, (f, t) in enumerate(some):
                pieces = t.split("\n")
                lines += [(f, x + "\n" * (k + 1 < len(pieces) or n + 1 < len(some))) for k, x in enumerate(pieces)]
            if not whole:
                lines = [] if len(some) < 2 else lines
            owner = [k for k, (_, x) in enumerate(lines) for _ in x.encode()]
            want, at, crossing = [0.0] * len(lines), 0, 0
            tokens = [enc.decode_single_token_bytes(x) for x in enc.encode_ordinary(whole)]
            for token in tokens:
                of = Counter(owner[at : at + len(token)])
                crossing += len(of) > 1
                if rule == "start":
                    want[owner[at]] += 1
                elif rule == "most":
                    want[min(of, key=lambda k: (-of[k], k))] += 1
                else:
                    for k, n in of.items():
                        want[k] += n / len(token)
                at += len(token)
            crossed += crossing
            assert (r.n_tokens, r.n_sections, r.n_crossing) == (len(tokens), len(lines), crossing)
            assert [s.field for s in r.sections] == [f for f, _ in lines] and [s.n_bytes for s in r.sections] == [len(x.encode()) for _, x in lines]
            assert np.allclose([s.tokens for s in r.sections], want)
    assert crossed > 20
    assert token_counts.count_tokens(docs_of(spark, [])).isEmpty()


def test_tokens_of_long_runs(spark):
    """Blanks and unbroken letters of any length; where the pattern can still do it, against the pattern."""
    e = encoder()
    for n in (999, 1000, 1001, 4000):
        for blank in (" ", "\n", " \n", "\t", "\u3000", "\x85"):
            for t in (blank * n, "a" + blank * n, blank * n + "b", "a," + blank * n + "1", blank * n + "'s", "x" + blank * n + "!" + blank * n + " y", "\x1f" + blank * n + "\x1f"):
                want = [len(e.encoding.decode_single_token_bytes(x)) for x in e.encoding.encode_ordinary(t)]
                assert np.diff(e.ends(t), prepend=0).tolist() == want
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "y" * 1_000_000, "!" * 300_000]
    for r in token_counts.count_tokens(docs_of(spark, texts)).collect():
        assert sum(s.n_bytes for s in r.sections) == len(texts[r.doc_id]) and math.isclose(sum(s.tokens for s in r.sections), r.n_tokens) and r.n_tokens > 1000


def test_url_rules_against_every_rule(spark, tmp_path):
    urls = [None, "", "no scheme", "http://example.net/en/a", "https://a.EXAMPLE.net/x", "http://net", "ftp://sub.example.com/de/x?q", "http://x.org/fr/y#z", "http://spam-farm.biz/", "http://a.b/casino/x", "http://example.com://x/casino", "http://a.org/" + "b" * 200_000 + "/casino/", "http://a.net" + "/é" * 50_000]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").withColumn("k", F.lit(1)).withColumn("rule", F.lit(2))
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    want = {}
    for k, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        address = (m[1].lower() + m[2]) if m else ""
        best = max((r for r in rules if re.search(r.pattern, address)), key=lambda r: (r.rank, r.name), default=None)
        want[k] = (best and best.name, best.verdict if best else "allow")
    table = spark.createDataFrame([(r.name, r.pattern, r.verdict, r.rank, list(r.tokens)) for r in rules], "name string, pattern string, verdict string, rank long, tokens array<string>")
    table.write.parquet(str(tmp_path / "rules.parquet"))
    table.drop("tokens").write.parquet(str(tmp_path / "bare.parquet"))
    for some in (rules, url_rules.read_rules(spark, str(tmp_path / "rules.parquet")), url_rules.read_rules(spark, str(tmp_path / "bare.parquet"))):
        for block in (url_rules.BLOCK, 3):  # one block, and several passes
            assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, some, block=block).collect()} == want
    assert url_rules.judge_urls(pages.where("false")).isEmpty()
    assert {r.verdict for r in url_rules.judge_urls(pages, ()).collect()} == {"allow"}


def test_tokens_that_a_pattern_needs():
    want = {
        r"(?:^|[.-])spam-farm\.": {"spam", "farm"}, r"casino": set(), r"(?:^|[./-])casino(?:[./-]|$)": {"casino"}, r"^ads\d+\.": set(), r"^(?:[^/]*\.)?example\.net/en/": {"net", "en"},
        r"/Track/(?:a|b)/pixel\.gif$": {"track", "pixel", "gif"}, r"[./]x?y/": set(), r"\bviagra\b": {"viagra"}, r"(?:a|/)b/": set(), r"/(?:b)/": {"b"}, r"/a\Bb/": set(), r"(?i)/Pixel/log/": {"log"},
    }
    assert {p: set(url_rules.needed_tokens(p)) for p in want} == want


def test_license_scan_on_planted_lines(spark):
    """Of the documents that speak of a licence at least nine in ten must be found, and no others; read by a plain pattern."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {r.doc_id for r in docs.where(F.col("text").rlike("(?i)licensed|license[ .,]|rights reserved")).select("doc_id").collect()}
    got = {r.doc_id for r in license_scan.scan_licenses(with_clashes(docs)).where("n_matches > 0").collect()}
    assert len(said) > 20 and len(got & said) >= 0.9 * len(said) and len(got - said) <= 0.1 * len(said)


def test_license_notices_and_whole_texts(spark, tmp_path):
    mit = dict(license_scan.WHOLE)["MIT"]
    texts = odd_texts() + [
        "Copyright 2020 Jane Doe. All rights reserved.", "# SPDX-License-Identifier: MIT", "This file is licensed under the MIT License.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Copyright (c) 2020 A B\n\n" + mit, "// " + mit.replace(" ", "\n// ", 30) + "\nint main() {}", "some text that is under no licence at all", "x " * 200_000 + mit,
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    n = len(odd_texts())
    assert [got[n + k].license for k in range(8)] == ["All-rights-reserved", "MIT", "MIT", "GPL-2.0", "MIT", "MIT", None, "MIT"]
    assert got[n + 4].dice == 1.0 and all(got[k].license is None for k in range(n))
    long = " ".join(f"clause{k} says that word{k % 91} shall not be part{k % 17}" for k in range(700))
    (tmp_path / "Long-1.txt").write_text(long)
    templates = license_scan.read_templates(spark, str(tmp_path))
    assert templates == (("Long-1", long),)
    edited = " ".join(w for k, w in enumerate(long.split()) if k % 23)
    r = license_scan.scan_licenses(docs_of(spark, ["intro " + edited + " end", long[:2000]]), templates).orderBy("doc_id").collect()
    assert r[0].license == "Long-1" and 0.85 < r[0].dice < 0.99 and r[1].license is None
    spark.createDataFrame([("Long-1", long)], "name string, text string").write.parquet(str(tmp_path / "t.parquet"))
    assert license_scan.read_templates(spark, str(tmp_path / "t.parquet")) == templates
    assert license_scan.scan_licenses(docs_of(spark, [])).isEmpty()


def test_license_scan_against_every_run_of_words(spark):
    rng = random.Random(4)
    templates = license_scan.TEMPLATES + (("Two", "One may copy this work freely.\n\nNo warranty of any kind is given by its makers."),)
    notices = [t for _, t in license_scan.NOTICES] + [templates[-1][1]]
    texts = [f"{notices[0]} and then a good deal of other text that has nothing to do with it at all", "# Copyright x\n#\n# " + notices[4].replace("licensed", "licensed\n#") + "\n#\n# import of much else follows here", "x y z\n\n" + notices[-1] + "\n\nw v", "Licensed under CC BY-NC 4.0.", " * Licensed under CC\n * BY 4.0 or not", "licensed under " * 300]
    for _ in range(30):
        w = [f"f{k}" for k in range(rng.randrange(10))]
        for _ in range(2):
            some = [x for x in rng.choice(notices).split() if rng.random() < 0.93]
            w += some + [rng.choice(some or ["q"]) for _ in range(rng.randrange(4))]
        texts.append("".join(x + rng.choice((" ", " ", "\n", "\n\n")) for x in w))
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts), templates, names=False).collect()}
    sets = [(name, license_scan.bigrams(license_scan.normal_words(t))) for name, t in templates]
    for i, t in enumerate(texts):
        w, best = license_scan.normal_words(t), 0.0
        for a in range(len(w)):
            for b in range(a + 2, min(len(w), a + 320) + 1):
                g = set(zip(w[a:b], w[a + 1 : b], strict=False))
                best = max(best, max(2 * len(g & x) / (len(g) + len(x)) for _, x in sets))
        assert math.isclose(got[i].dice, best if best >= 0.8 - 1e-12 else 0.0), t
    assert [got[i].licenses for i in range(6)] == [["Apache-2.0"], ["GPL-3.0"], ["Two"], ["CC-BY-NC-4.0"], ["CC-BY-4.0"], []]


NAMED = {
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"], "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"], "Licensed under CC BY 3.0": ["CC-BY-3.0"], "Licensed under CC BY 2.5": [],
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"], "Dual licensed under the MIT and GPL licenses.": ["MIT OR GPL"],
    "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"], "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0"], "SPDX-License-Identifier: LGPL-2.1-only": ["LGPL-2.1-only"],
    "MIT License\n\nCopyright (c) 2020 Jane Doe": ["MIT"], "The MIT License (MIT)": ["MIT"], "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "Released under the BSD license": ["BSD"], "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": ["Apache-2.0"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "This work is licensed under the GNU Lesser General Public License, version 3.": [], "Licensed under the Apache License, Version 1.1.": [],
    "Licensed under the MIT License. See 3 files": ["MIT"], "We met at MIT and saw version 2.0": [],
}


def test_license_names(spark, tmp_path):
    """A near name gives way to its own template, or to none; in one pass and in several."""
    texts = list(NAMED)
    got = {texts[r.doc_id]: r.licenses for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == NAMED
    spark.createDataFrame(license_scan.TEMPLATES + (("One", "word1"),), "name string, text string").write.parquet(str(tmp_path / "t.parquet"))
    blocks = license_scan.read_templates(spark, str(tmp_path / "t.parquet"), most=5000)
    assert isinstance(blocks, license_scan.Blocks) and len(list(blocks)) > 3
    more = [*texts, None, "", "word1\nx", "x " * 30_000 + texts[0]]
    whole = license_scan.scan_licenses(docs_of(spark, more), license_scan.TEMPLATES + (("One", "word1"),))
    assert sorted(map(str, license_scan.scan_licenses(docs_of(spark, more), blocks).collect())) == sorted(map(str, whole.collect()))


def test_ledger_policies_and_ablations(spark):
    texts = odd_texts() + ["word " * 60, "A B C " * 40, "\n".join(["same line of words"] * 20), "# $ % " * 30]
    book = quality_ledger.ledger(docs_of(spark, texts)).cache()
    assert {r.doc_id for r in book.where(quality_ledger.passes("base")).collect()} >= {r.doc_id for r in book.where(quality_ledger.passes("v1")).collect()}
    by_rule = {r.rule: (r.n_failed, r.n_only_this) for r in quality_ledger.ablations(book).collect()}
    failed = [r.failed for r in book.collect()]
    for rule in quality_ledger.RULES:
        assert by_rule[rule.name] == (sum(f >> rule.bit & 1 for f in failed), sum(f == 1 << rule.bit for f in failed))
    clashing = quality_ledger.ledger(with_clashes(docs_of(spark, texts)).withColumn("a.b", F.lit(1)))
    assert {(r.doc_id, r.failed, r.n_words) for r in clashing.collect()} == {(r.doc_id, r.failed, r.n_words) for r in book.collect()}
    assert clashing.columns.count("failed") == 1 and "a.b" in clashing.columns and clashing.where(quality_ledger.passes("v1")).count() == sum(f == 0 for f in failed)
    kept = quality_ledger.filter_documents(with_clashes(docs_of(spark, texts)))
    assert "spans" in kept.columns and kept.count() == sum(f == 0 for f in failed)
    assert quality_ledger.filter_documents(docs_of(spark, [])).isEmpty()
