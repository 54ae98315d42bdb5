"""Fingerprints, BPE and packing against brute force and the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casegraph.llm import bpe, fingerprint, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "A  a", "ａ\ta", "x" * 5000, "Hello\n\nworld  it's 'twas they'LL we've ½ ² 日本語", "a<|endoftext|>b", "<|endoftext|>", "tail  \n ", "''s 's't", "hello hello " * 700, "\0x\r\n"]
SCHEMA = "doc_id long, text string, bucket string, digest int"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_pairs_and_words_agree_with_exact_merging():
    b = bpe.load(PATH)
    rng = random.Random(3)
    plain = [i for i, t in enumerate(b.token) if t and i not in b.special.values()]
    left, right = ([rng.choice(plain) for _ in range(4000)] for _ in "lr")
    ok = b.compatible(np.array(left), np.array(right))
    for l, r, o in zip(left, right, ok, strict=True):
        assert (b.heap_merge(b.token[l] + b.token[r]) == [l, r]) == o
    words = ["".join(rng.choice("aeth nsoé'") for _ in range(rng.randint(0, 90))).encode() for _ in range(800)]
    for found in (b.exact(words), b.encode_words(words)):
        parts = np.split(found[0], np.cumsum(found[1])[:-1])
        assert [p.tolist() for p in parts] == [b.heap_merge(w) for w in words]


def test_encoding_equals_the_library():
    b, library = bpe.load(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    letters = "ab th's 'll\n\t\r .,!?é½9０  日" + "<|endoftext|>"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    flat, counts = b.encode_batch(texts)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for t, p, back in zip(texts, parts, b.decode_batch(flat, counts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert p.tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_cache_restart_changes_nothing(monkeypatch):
    b = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    one = [b.encode_batch([t or ""])[0].tolist() for t in ODD]
    assert one == [bpe.load(PATH).encode_batch([t or ""])[0].tolist() for t in ODD]


def test_op2_rows(spark):
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs(spark, ODD), PATH, ids=True).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("bits", [128, 3])
def test_fingerprints(spark, monkeypatch, bits):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    ids = [7, -5, 2**62, 40, 41, 42, 3, 99, None, 1000, 5, 6, 60, -(2**62)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint(docs(spark, ODD, ids), bits).collect()}
    order = sorted(zip(ids, ODD, strict=True), key=lambda x: -(2**63) if x[0] is None else x[0], reverse=True)
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r["near_edited"] == float(fingerprint.canonical(t) == fingerprint.canonical(edited))
        assert r["near_next"] == float(fingerprint.canonical(t) == fingerprint.canonical(other))
        for j, u in order:
            same = fingerprint.canonical(t) == fingerprint.canonical(u or "")
            assert (r["fingerprint"] == got[j]["fingerprint"]) == same, (i, j)


def test_fingerprints_of_repeated_rows_and_none(spark):
    assert fingerprint.fingerprint(docs(spark, [])).count() == 0
    one = fingerprint.fingerprint(docs(spark, ["abcd"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprint(docs(spark, ["a", "a", "b"], [1, 1, 1])).count() == 3


def unpack(rows, most=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= most
    return bins


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 6000))) for _ in range(60)] * 2
    rows = packing.pack(docs(spark, texts), PATH).collect()
    library = Tokenizer.from_file(PATH)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and mine[0]["start"] == 0
        assert all(r["length"] == 2048 for r in mine[1:]) and sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += len(ids)
    assert len(unpack(rows)) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    rng = random.Random(2)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 760), 150)}
    table = packing.plan(counts, 1024, 6, 600_000, rule)
    bins, ranks = {}, {}
    for length, rank, n, first, offset in table.tolist():
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for s in range(first, first + n):
            bins.setdefault(s, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for places in bins.values():
        assert len(places) <= 6 and sum(n * n for _, n in places) <= 600_000
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
