"""Language and toxicity models: accuracy on documents they weren't fitted on, and degenerate tables."""

import random
import re
import zlib

import numpy as np

from casegraph.llm import language, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, y0 int"
WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "quick brown wolf jumps über".split(), "cc": "ñandú cerca agua río sol".split()}


def test_language(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        text = " ".join("".join(rng.choice(WORDS[lang])[: rng.randint(2, 9)]) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if i % 9 else None, 0.0, 1))
    truth = {r[0]: (r[1], r[2]) for r in rows}
    rows += [(1000, None, "aa", 0.0, 1), (1001, "", None, 0.0, 1), (1002, "123 !?", "bb", 0.0, 1), (None, rows[0][1], "aa", 0.0, 1), (3, rows[3][1], rows[3][2], 0.0, 1), (1003, "agua " * 30_000, None, 0.0, 1)]
    got = language.result(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    good = total = 0
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in truth and r["held_out"] and truth[r["doc_id"]][1]:
            total += 1
            good += truth[r["doc_id"]][1] == r["lang_pred"]
    assert total > 40 and good / total > 0.97
    named = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [named[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    none = spark.createDataFrame([(1, "a b", None, 0.0, 1)], SCHEMA)
    assert [r["lang_pred"] for r in language.result(none).collect()] == ["und"]
    assert language.result(none.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    bad_words = ["vile", "rotten", "nasty", "foul"]
    rows, labels, truth = [], [], {}
    for i in range(900):
        toxic = rng.random() < 0.2
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 80))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad_words).upper() + rng.choice([",", "", "!"]))
        truth[i] = toxic
        rows.append((i, " ".join(words), "x", 0.0, 5))
        if i % 3:
            labels.append((i, int(rng.random() < 0.7), int(toxic)))
    rows += [(2000, None, "x", 0.0, 5), (2001, "", "x", 0.0, 5), (2002, " " * 9, "x", 0.0, 5), (1, rows[1][1], "x", 0.0, 5), (None, "vile rotten nasty foul", "x", 0.0, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.result(df, marks).collect()
    assert len(got) == len(rows)
    held = [(r["toxic"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["doc_id"] % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {r["toxic"] for r in got if r["doc_id"] in (2000, 2001, 2002)} == {False}
    assert all(0 <= r["p_toxic"] <= 1 for r in got)
    assert [r["toxic"] for r in toxicity.result(df.limit(3), marks.limit(0)).collect()] == [False] * 3
    assert toxicity.result(df.limit(0), marks).count() == 0


def grams(text):
    """All runs of one to three characters, what is no letter being one blank."""
    t = re.sub(r"[\W\d_]+", " ", text.lower()).lstrip() + " "
    t = t.replace("  ", " ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_language_is_kernel_ridge_regression(spark):
    """With every row a landmark, margins are those of an explicit kernel, solved in its dual."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(2, 6))), lang) for i, lang in enumerate(["aa"] * 20 + ["bb"] * 30 + ["cc"] * 10)]
    names, weights = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=600)
    sets = [grams(t) for _, t, _ in rows]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    at = np.array([names.index(lang) for _, _, lang in rows])
    weight, ridge, n = (1 / np.bincount(at))[at] / 3, 1e-3 / 3, len(rows)
    target = np.where(at[:, None] == np.arange(3), 1.0, -1.0)
    left = np.block([[weight[:, None] * kernel + ridge * np.eye(n), weight[:, None]], [weight[None] @ kernel, weight.sum()[None, None]]])
    dual = np.linalg.solve(left, np.concatenate([weight[:, None] * target, weight[None] @ target]))
    want = kernel @ dual[:-1] + dual[-1]
    got = language.normalised(language.presences([t for _, t, _ in rows])[0]) @ weights[:-1] + weights[-1]
    assert names == ["aa", "bb", "cc"] and np.abs(got - want).max() < 0.05 and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_toxicity_models_are_ridge_regressions():
    """Balanced weights and the solution by normal equations; its calibration has no better slope nearby."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 12)) < 0.3).astype(np.float32)
    y = x[:, 0] + x[:, 1] + rng.random(300) > 1.3
    w, b = toxicity.linear(x, y)
    margin = x @ w + b
    assert ((margin > 0) == y).mean() > 0.85
    loss = lambda a, c: -np.where(y, np.log(toxicity.sigmoid(a * margin + c)), np.log1p(-toxicity.sigmoid(a * margin + c))).sum() + 5e-3 * a * a
    a, c = toxicity.calibrate(margin, y.astype(float))
    assert all(loss(a, c) <= loss(a + d, c + e) + 1e-6 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))
