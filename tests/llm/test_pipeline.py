"""The corpus pipeline against the brute-force versions of its stages, one after the other."""

import random
import zlib

import numpy as np
import public_tokenizers
from test_near import brute as brute_near
from test_rules import brute_lines, brute_stats
from test_substrings import brute as brute_cut
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(n))
    passage, block = " ".join(word() for _ in range(30)), text(4)
    rows, base = [], text(12)
    for i in range(40):
        t = text(rng.randint(2, 14))
        if i % 5 == 0:
            t = f"{t}\n{passage}\n{text(2)}"
        if i % 7 == 0:
            t = f"{t}\n{block}\n{text(1)}"
        if i % 8 == 0:
            words = base.split(" ")
            words[rng.randrange(len(words))] = word()
            t = " ".join(words)
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "short text"), (103, "again and " * 60), (104, rows[3][1]), (105, rows[4][1])]
    return rows


def brute(rows):
    rows = [(d, t) for d, t in rows if (s := brute_stats(t)) and s[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    cut = brute_lines(rows)
    rows = [(d, cut[d, t][2]) for d, t in rows if not cut[d, t][1] or cut[d, t][2].split()]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, brute_near(rows, 5, 80), strict=True) if d == c]
    left = brute_cut(rows)
    return [(d, b[4].decode("utf-8", "ignore") if b[1] else t) for (d, t), b in zip(rows, left, strict=True) if not b[1] or b[4].split()]


def test_run(spark, tmp_path):
    rows = corpus(random.Random(11))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted({r["doc_id"] for r in got}) == sorted(d for d, _ in want) and len(want) < len(rows) - 6
    for d, t in want:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for r in (r for r in got if r["doc_id"] == d):
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in got if r["doc_id"] == d) == len(ids)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048


def test_stages_keep_columns(spark, tmp_path):
    rows = corpus(random.Random(12))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).schema.names == docs.schema.names
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
