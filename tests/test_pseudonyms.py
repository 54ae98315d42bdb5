"""Pseudonyms against replacement value by value on small alphabets, where nearly everything overlaps."""

import random
import re

import pytest

from casegraph.operators import pseudonyms

SCHEMA = "n long, text string"
LABELS = "value string, label string"


def brute(text: str, labels: dict[str, str]) -> list[tuple[int, int, str]]:
    """Spans by trying each value, longest first, at each place."""
    taken, out = [False] * len(text), []
    for v in sorted(labels, key=lambda v: (-len(v), v)):
        for s in range(len(text) - len(v) + 1):
            if text[s : s + len(v)] == v and not any(taken[s : s + len(v)]):
                taken[s : s + len(v)] = [True] * len(v)
                out.append((s, s + len(v), labels[v]))
    return sorted(out)


def plain(text: str, labels: dict[str, str]) -> str:
    """The text with its labels, without marks."""
    out, last = "", 0
    for s, e, label in brute(text, labels):
        out, last = out + text[last:s] + label, e
    return out + text[last:]


@pytest.mark.parametrize("seed", range(3))
def test_as_one_by_one_and_back(spark, seed):
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphabet = ["ab", "ab-1⁠ ", "aé😀_."][seed]
    values = sorted({pick(alphabet, rng.choice([1, 2, 3, 4, 5, 8, 12, 63, 64, 65, 130])) for _ in range(60)} - {""})
    labels = {v: f"{rng.choice(['CUENTA', 'IP', 'ALIAS_PAGO'])}-{k}" for k, v in enumerate(values)}
    some = list(labels.values())
    texts = ["".join(rng.choice([pick(alphabet, rng.randint(0, 30)), rng.choice(values), rng.choice(some), rng.choice(["CUENTA-", "-7", "⁠", "IP"])]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    named = spark.createDataFrame(list(labels.items()), LABELS)
    secret = pseudonyms.hidden(df, "text", named)
    got = {r["n"]: r["text"] for r in secret.collect()}
    assert {n: t.replace(pseudonyms.MARK, "") for n, t in got.items()} == {n: plain(t, labels).replace(pseudonyms.MARK, "") for n, t in enumerate(texts)}
    assert {r["n"]: r["text"] for r in pseudonyms.restored(secret, "text", named).collect()} == dict(enumerate(texts))


def test_edges(spark):
    labels = spark.createDataFrame([("abcd", "IP-1"), ("abcd", "IP-2"), ("", "IP-3"), (None, "IP-4"), ("zz", None), ("x" * 200 + "1", "IP-5"), ("x" * 200 + "2", "IP-6")], LABELS)
    rows = [(1, None), (2, ""), (3, "abcd"), (3, "abcd"), (4, "abcd" * 3), (5, "x" * 200 + "2 zz")]
    texts = spark.createDataFrame([(*r, k, "own") for k, r in enumerate(rows)], "n long, text string, id long, `row.of` string")
    out = pseudonyms.hidden(texts, "text", labels)
    assert out.columns == texts.columns
    joined = pseudonyms.MARK.join(["IP-1"] * 3)
    assert sorted((r["id"], r["text"]) for r in out.collect()) == list(enumerate([None, "", "IP-1", "IP-1", joined, "IP-6 zz"]))
    assert sorted(map(tuple, pseudonyms.restored(out, "text", labels.filter("label <> 'IP-2'")).collect()), key=lambda r: r[2]) == sorted(map(tuple, texts.collect()), key=lambda r: r[2])
    assert pseudonyms.hidden(texts.limit(0), "text", labels).count() == 0
    assert pseudonyms.hidden(texts, "text", labels.limit(0)).count() == len(rows)
    only = pseudonyms.hidden(texts.select("text"), "text", labels)
    assert only.columns == ["text"] and only.count() == len(rows)


def test_very_long_text_over_slices(spark, monkeypatch):
    """Values across the slices that are hashed side by side."""
    rng = random.Random(9)
    values = {f"user{k}/name{k}": f"CUENTA-{k}" for k in range(2000)}
    text = " ".join(rng.choice([*values, "word", "other"]) for _ in range(150_000))
    assert len(text) > pseudonyms.SLICE
    texts, labels = spark.createDataFrame([(1, text)], SCHEMA), spark.createDataFrame(list(values.items()), LABELS)
    got = pseudonyms.hidden(texts, "text", labels)
    assert got.first()["text"] == re.sub(r"user\d+/name\d+", lambda m: values[m[0]], text)
    assert pseudonyms.restored(got, "text", labels).first()["text"] == text


def test_labels_ask_for_themselves_alone(spark):
    """CUENTA-2 and CUENTA-25 stand in CUENTA-255, but restored() takes whole words: one row for it, not three."""
    words = pseudonyms.known(spark.createDataFrame([(f"CUENTA-{n}", f"v{n}") for n in range(300)] + [("ñ" * 70, "v")], "word string, label string"))
    texts = spark.createDataFrame([(1, "CUENTA-255"), (2, "a CUENTA-7."), (3, "xCUENTA-1"), (4, "-" + "ñ" * 70)], "id long, text string")
    assert sorted(r["id"] for r in pseudonyms.found(texts, words, True).collect()) == [1, 2, 4]
    assert pseudonyms.found(texts, words).filter("id = 1").count() == 3


def test_few_words_as_with_many(monkeypatch):
    words = {"aa": "1", "aaa": "2", "ab": "3", "b": "4"}
    few = sorted(pseudonyms._hits("aaaabaab", words))
    monkeypatch.setattr(pseudonyms, "FEW", 0)
    assert few == sorted(pseudonyms._hits("aaaabaab", words)) and len(few) == 10
