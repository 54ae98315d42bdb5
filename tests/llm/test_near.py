"""Near-duplicate classes against brute force."""

import random
import re

import pytest

from casegraph.llm import minhash

SCHEMA = "doc_id long, text string, label string, key long, v int"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus(rng, copies, chain):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "two one", "É x y z", "é x y z"]
    for _ in range(copies):
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(60)] = word()
        texts.append(rng.choice([" ", "\t", " \n"]).join(edited))
    walk = list(base[::-1])  # a chain whose ends are far apart
    for _ in range(chain):
        walk[rng.randrange(60)] = word()
        texts.append(" ".join(walk))
    texts += [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts += texts[8:14]
    rng.shuffle(texts)
    return list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1 << 21), (3, 85, 300), (5, 80, 1 << 21)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(minhash, "HOT_MEMBERS", 2 if block == 300 else 256)
    rows = corpus(random.Random(width), 60, 60)
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    plan = minhash.Plan(width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, plan).collect()}
    want = {d: (n, c, c == d) for d, n, c in brute(rows, width, percent)}
    assert got == want
    if block > 300:
        kept = minhash.keep_one(df, plan)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, _, k) in want.items() if k)


def test_degenerate_tables(spark):
    plan = minhash.Plan(3, 85)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA), plan).count() == 0
    rows = [(1, "a b c", "x", 1, 2), (1, "a b c", "x", 1, 2), (None, "A B C", "x", 1, 2), (None, None, "x", 1, 2), (7, "q r s t", "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(df, plan).collect()
    assert sorted((r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 7)]
    assert sorted(str(r["text"]) for r in minhash.keep_one(df, plan).collect()) == ["None", "a b c", "q r s t"]


def test_very_long_texts_and_clashing_names(spark):
    """Texts of 200,000 words; the names that the operator uses inside are a user's here."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    texts = [" ".join(words), " ".join(words[:1000] + ["x"] + words[1000:]), " ".join(words[:100_000])]
    df = spark.createDataFrame([(i, t, 5, 6, "h", 8) for i, t in enumerate(texts)], "doc_id long, text string, id int, rank int, hash string, blank int")
    out = minhash.keep_one(df, minhash.Plan(5, 80)).collect()
    assert sorted((r["doc_id"], r["id"], r["rank"], r["hash"], r["blank"]) for r in out) == [(0, 5, 6, "h", 8), (2, 5, 6, "h", 8)]


def test_sequential_test_keeps_pairs_over_the_threshold():
    plan = minhash.Plan(3, 85)
    import numpy as np

    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (20_000, plan.size), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.85, left, left ^ np.uint32(1))
    assert len(plan.survive(left, right)) >= 19_990
    right = np.where(rng.random(left.shape) < 0.4, left, left ^ np.uint32(1))
    assert len(plan.survive(left, right)) <= 5
