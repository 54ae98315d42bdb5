"""Suffix arrays and exact substring removal against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from casegraph.llm import grams, substrings
from casegraph.llm.suffixes import suffix_arrays

SCHEMA = "doc_id long, text string, group string, tie int"


def test_suffix_arrays_of_all_short_strings():
    strings = [s for n in range(8) for s in itertools.product(range(2), repeat=n)] + [s for n in range(6) for s in itertools.product(range(3), repeat=n)]
    rng = random.Random(1)
    for _ in range(200):
        word = [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
        strings.append(tuple((word * 12)[: rng.randint(1, 60)] + [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]))
    sizes = np.array([len(s) for s in strings])
    got = suffix_arrays(np.array([x for s in strings for x in s]), sizes).tolist()
    at = 0
    for s in strings:
        assert got[at : at + len(s)] == [at + i for i in sorted(range(len(s)), key=lambda i: s[i:])], s
        at += len(s)


def brute(rows, match=50):
    raw = [((-(2**63) if d is None else d), (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in raw:
        for i in range(len(b) - match + 1):
            w = b[i : i + match]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            if least[b[i : i + match]] < d:
                gone[i : i + match] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest(), left))
    return out


def corpus(rng):
    letters = "abcdefgh ijk.é日"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([49, 50, 51, 80, 400])) for _ in range(8)] + ["a" * 70, "ab" * 60]
    texts = [None, "", "x", text(49), "a" * 300, "ab" * 200]
    for _ in range(60):
        texts.append("".join(rng.choice([text(rng.randint(0, 90)), rng.choice(passages)]) for _ in range(rng.randint(1, 7))))
    texts += texts[10:16]
    near = list(text(700))
    for _ in range(12):
        near[rng.randrange(700)] = "#"
        texts.append("".join(near))
    ids = rng.sample(range(-50, 10_000), len(texts))
    return list(zip(ids, texts, strict=True)) + [(None, texts[20]), (ids[20], texts[21]), (ids[30], texts[30])]


def by(table, name):
    keys = table.column(name).to_pylist()
    return {k: table.take([i for i, x in enumerate(keys) if x == k]) for k in sorted(set(keys))}


def here(rows, groups, shards, wards):
    """cut() in one process, as the groups and shards work."""
    z = zstandard.ZstdCompressor()
    packed = [None if t is None else z.compress(t.encode()) for _, t in rows]
    dealt = pa.table({"group": pa.array([i * 7 % groups for i in range(len(rows))], pa.int64()), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "packed": pa.array(packed, pa.binary())})
    dealt = by(dealt, "group")
    none = substrings._rows(substrings._GROUP_ROW, [])
    step = lambda found, f: pa.concat_tables([f(k, t) for k, t in found.items()] or [none])
    marks = by(step(by(step(dealt, lambda _, t: substrings.tell(t, wards)), "shard"), lambda _, t: substrings.census(t)), "group")
    asked = by(step(dealt, lambda g, t: substrings.ask(t, marks.get(g, none), shards)), "shard")
    answers = by(step(asked, lambda _, t: substrings.answer(t)), "group")
    done = step(dealt, lambda g, t: substrings.remove(t, answers.get(g, none), False))
    return sorted(map(str, done.to_pylist()))


@pytest.mark.parametrize("common", [2, 5, 1 << 20])
@pytest.mark.parametrize("broken", [False, True])
def test_groups_and_shards(monkeypatch, common, broken):
    """Common anchors go in pieces; with hashes that say nothing, bytes decide."""
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 500)
    monkeypatch.setattr(substrings, "SORT_BYTES", 400)
    if broken:
        monkeypatch.setattr(substrings, "_content", lambda raw, begin, size, offset: np.zeros(len(begin), np.uint64))
        true = grams.span_hashes
        monkeypatch.setattr(substrings, "span_hashes", lambda raw, first, size, sized=False: true(raw, first, size) % np.uint64(3) if sized else true(raw, first, size))
    for seed in (3, 4):
        rows = corpus(random.Random(seed))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        want = sorted(str(dict(zip(names, (d, *b[:4]), strict=True))) for (d, _), b in zip(rows, brute(rows), strict=True))
        for groups, shards, wards in ((9, 5, 3), (40, 17, 6)):
            assert here(rows, groups, shards, wards) == want


def test_cut_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 700)
    monkeypatch.setattr(substrings, "CENSUS_BYTES", 2500)
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([(d, t, "g", 1) for d, t in rows], SCHEMA)
        key = lambda r: (str(r[0]), *map(str, r[1:]))
        want = sorted(((d, *b[:4]) for (d, _), b in zip(rows, brute(rows), strict=True)), key=key)
        assert sorted(map(tuple, substrings.result(df).collect()), key=key) == want
    out = substrings.stage(df)
    assert out.columns == df.columns
    left = [(d, b[4].decode("utf-8", "ignore") if b[1] else t) for (d, t), b in zip(rows, brute(rows), strict=True) if not b[1] or b[4].split()]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(left, key=str)


def test_very_long_texts_and_clashing_names(spark):
    """Two texts of 3 MB that share their second half; the names that the stage uses inside are a user's here."""
    rng = np.random.default_rng(3)
    parts = ["".join(map(chr, rng.integers(97, 123, 1_500_000))) for _ in range(3)]
    df = spark.createDataFrame([(1, parts[0] + parts[2], 5, "a", 7, 8), (2, parts[1] + parts[2], 6, "b", 9, 10)], "doc_id long, text string, hash long, left string, id int, row int")
    out = {r["doc_id"]: r for r in substrings.stage(df).collect()}
    assert out[1]["text"] == parts[0] + parts[2] and out[2]["text"] == parts[1]
    assert [tuple(out[k])[2:] for k in (1, 2)] == [(5, "a", 7, 8), (6, "b", 9, 10)]


def test_empty_tables(spark):
    assert substrings.result(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substrings.stage(spark.createDataFrame([(1, None, "g", 1)], SCHEMA)).count() == 1
