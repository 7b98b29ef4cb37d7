"""The pipeline's stages and its run against a plain version of the same decisions."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from weftgraph.plans.shared import listed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_rules(t):
    """Whether the quality rules keep a text."""
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    chars = sum(map(len, w))
    return not (
        len(w) < 50 or 2 * len(again) > len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * len(w)
        or (len(lines) > 3 and 2 * (len(lines) - len(set(lines))) > len(lines)) or 10 * len(re.findall("[A-Z]", t)) > 7 * chars or chars > 25 * len(w)
    )


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_clean(t, item):
    """A text without the item's windows, or None if it is contaminated."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    found = list(re.finditer(ITEM_WORD, lower))
    w, want = [m[0] for m in found], re.findall(ITEM_WORD, item)
    windows = {tuple(want[k : k + 13]) for k in range(max(1, len(want) - 12))}
    hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
    if hit and 20 * len(hit) >= len(w):
        return None
    out, k = t, len(w) - 1
    while k >= 0:  # from the end, so that places stay right
        if k in hit:
            last = k
            while k - 1 in hit:
                k -= 1
            out = out[: found[k].start()] + out[found[last].end() :]
        k -= 1
    return out


def corpus(rng):
    def prose(n):
        return [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]

    passage, item = prose(60), prose(30)
    texts = [" ".join(prose(rng.randrange(60, 200))) for _ in range(40)]
    texts += ["too short", None, "", "la la la " * 60]  # the rules reject these
    base = prose(150)
    texts += [" ".join(w if rng.random() > 0.01 else "edit" for w in base) for _ in range(6)]  # near copies
    texts += [" ".join([*prose(90), *passage, *prose(40)]) for _ in range(5)]  # a repeated passage
    texts += [" ".join([*prose(70), *item[:20], *prose(30)]), " ".join([*prose(400), *item[5:20], *prose(200)])]  # over and under the limit
    return texts, " ".join(item)


def test_run_against_plain_version(spark, tmp_path):
    rng = random.Random(8)
    texts, item = corpus(rng)
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    stay = {k for k, t in enumerate(texts) if plain_rules(t)}
    assert 40 < len(stay) < len(texts)
    grams, root = {}, {}
    for k in sorted(stay):
        w = [x.lower() for x in words(texts[k])]
        grams[k], root[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}, k
        for j in grams:
            if 100 * len(grams[k] & grams[j]) >= 80 * len(grams[k] | grams[j]):
                low, high = sorted((root[j], root[k]))
                root = {x: low if r == high else r for x, r in root.items()}
    kept = {k: texts[k] for k in sorted(stay) if root[k] == k}
    assert len(kept) < len(stay)
    seen = set()
    for k, t in kept.items():
        w, gone = words(t), set()
        for j in range(len(w) - 19):
            if (win := tuple(w[j : j + 20])) in seen:
                gone |= set(range(j, j + 20))
            seen.add(win)
        if gone:
            kept[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
    clean = {k: x for k, t in kept.items() if (x := plain_clean(t, item)) is not None}
    assert len(clean) < len(kept) and any(clean[k] != kept[k] for k in clean)

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == COLUMNS, name
        stage.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id: r.text for r in stage.collect()} == clean
    assert stage.where(F.length("text") != F.col("n_chars")).isEmpty()

    shared = shared_folder(spark)
    before = set(listed(spark, shared))
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (new,) = [n for n in set(listed(spark, shared)) - before if n.startswith(("pipeline-", "table-"))]
    assert listed(spark, f"{shared}/{new}") == ["4-source_weights"]  # what the run needed on its way is gone
    assert all(clean[r.doc_id] == r.text and r.taken > 0 for r in mixed)
    for s in {r.source for r in mixed}:
        some = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in some) - some[0].target) < 1.5


#: Names that operators use inside, of the last stage's own columns, and names with a dot.
CLASHES = ["size", "source_size", "target", "taken", "failed", "n_words", "row", "k", "th", "s", "spans", "may", "gone", "cut", "_k", "_id", "_s", "tie", "chunk", "a.b", "text.x", "row.text"]


def test_stages_take_nulls_repeats_clashing_names_and_no_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    t = " ".join(f"w{k}" for k in range(80))
    long = " ".join(f"v{k}x{k % 7}" for k in range(120_000))
    odd = [" " * 300_000, "y" * 300_000, "\n" * 1000 + "z"]  # blank and unbroken texts fail the first rule
    some = [(None, None, None, None, None), (1, t, None, None, 3), (1, t, None, None, 3), (None, t + " more", "en", None, 4), (2, "", "en", "s", 0), (3, long, "en", "s", len(long))]
    some += [(4 + k, x, "en", "s", len(x)) for k, x in enumerate(odd)]
    for rows in ([], some):
        stage = spark.createDataFrame(rows, kind).select("*", *[F.lit(c).alias(c) for c in CLASHES])
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            before = stage.columns
            path = str(tmp_path / f"{len(rows)}-{name}")
            f(spark, stage, str(tmp_path)).write.parquet(path)
            stage = spark.read.parquet(path)
            own = ["size", "source_size", "target", "taken"]
            assert stage.columns == (before if k < 4 else [c for c in before if c not in own] + own), name
        got = stage.collect()
        assert sorted(((r.doc_id, r.text == long) for r in got), key=str) == ([(3, True), (None, False)] if rows else [])
        assert all(r[c] == c for r in got for c in CLASHES if c not in own)


def test_run_again_agrees(spark, tmp_path):
    """Rows that share a doc_id and source but not their texts are told apart the same way each time."""
    rng = random.Random(1)
    rows = [(k % 7, " ".join(f"q{rng.randrange(9000)}" for _ in range(60)), "en", "ab"[k % 2], 0) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = (sorted(map(tuple, corpus_pipeline.source_weights(spark, docs.repartition(n), "").collect())) for n in (2, 5))
    assert a == b and len(a) > 40
