"""Links of large similarity groups: blocks of classes against all pairs written out."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import graph, similarity

FILES = "reportId string, ord long, evidence string, locator string, phash string, hash long, audio string"


def files_of(rng, extra):
    """75 + 75 files a bit apart, each of its own evidence; with extra: shared evidences, reports of several files, a third class."""
    rows = [(f"r{k:03}", f"e{k}", 255 if k < 75 else 511) for k in range(150)]
    if extra:
        rows = [(r, rng.choice(["same", "twin", e, e, e]), h) for r, e, h in rows]
        rows += [(f"r{rng.randrange(150):03}", f"x{k % 25}", rng.choice([255, 511, 1023, 0xFF00])) for k in range(60)]
        rows += [(f"s{k}", f"y{k}", 1023) for k in range(3)] + [("t0", "z0", 1535)]
    return [(r, k, e, f"f[{k}]", f"{h:016x}", h, "tone" if k % 2 else None) for k, (r, e, h) in enumerate(rows)]


def all_pairs(rows):
    """(a, b): weights of every firing, by reading each pair of files."""
    out = {}
    for x in rows:
        for y in rows:
            d = (x[5] ^ y[5]).bit_count()
            if x[1] < y[1] and x[0] != y[0] and x[2] != y[2] and 0 < d <= vocab.HAMMING_MOST:
                out.setdefault((min(x[0], y[0]), max(x[0], y[0])), []).append(round(0.82 * (1 - d / 64), 4))
    return out


def noisy(weights):
    left = 1.0
    for w in weights:
        left *= 1 - min(w, 0.99)
    return round(min(1 - left, 0.99), 4)


@pytest.mark.parametrize("extra", [False, True])
def test_blocks_stand_for_all_pairs(spark, monkeypatch, extra):
    rows = files_of(random.Random(4), extra)
    files = spark.createDataFrame(rows, FILES)
    if extra:
        monkeypatch.setitem(vocab.PAIR_CAPS, "HASH_PERCEPTUAL", 400)
    edges, near, large = similarity.near_files(files)
    assert large.filter("distance > 0").count() >= 1
    blocks, members = similarity.near_blocks(files, large)
    # Some pairs share something else, and so have rows of their own.
    asked = spark.createDataFrame([("r000", "r100"), ("r001", "r002"), ("r003", "r149")], "a string, b string")
    own = near.select("a", "b").union(asked).distinct()
    _, told = similarity.near_among(files, large, own)
    fired = near.unionByName(told).groupBy("a", "b").agg(F.collect_list("weight").alias("w")).collect()
    explicit = {(r["a"], r["b"]): noisy(r["w"]) for r in fired}
    whole = {p: noisy(w) for p, w in all_pairs(rows).items()}
    if not extra:
        assert len(whole) == 75 * 75 and set(whole.values()) == {0.8072} and blocks.count() == 1
    known = spark.createDataFrame([*explicit, ("r001", "r002")], "a string, b string").distinct()
    links = spark.createDataFrame([(a, b, w) for (a, b), w in explicit.items()], "a string, b string, weight double")
    implied = graph.Implied(blocks, members, known)
    got = {(r["a"], r["b"]): r["weight"] for r in implied.pairs_of(members).collect()} | explicit
    assert got == whole
    every = spark.createDataFrame([(a, b, w) for (a, b), w in whole.items()], "a string, b string, weight double")
    label = lambda df: {r["v"]: r["label"] for r in graph.components(df).collect()}
    sparse = links.unionByName(implied.certificate())
    assert label(sparse) == label(every)
    assert sorted(map(tuple, graph.bridges(sparse).collect())) == sorted(map(tuple, graph.bridges(every).collect()))
    labels = graph.components(sparse)
    assert sorted(map(tuple, graph.cases(labels, links, implied).collect())) == sorted(map(tuple, graph.cases(labels, every).collect()))
    ends = spark.createDataFrame([(f"r{k:03}",) for k in range(151)], "v string")
    table = lambda df: {r["v"]: r[1] for r in df.collect()}
    assert table(graph.degree(links, 151, ends, implied)) == table(graph.degree(every, 151, ends))
    one, two = table(graph.pagerank(links, ends, implied=implied)), table(graph.pagerank(every, ends))
    assert one.keys() == two.keys() and max(abs(one[v] - two[v]) for v in one) < 1e-6


def test_sound_classes_count_every_pair(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(60)}", k, f"e{rng.randrange(90)}", f"f[{k}]", None, None, rng.choice(["a"] * 6 + ["b", "c", None])) for k in range(160)]
    edges, classes = similarity.equal_audio(spark.createDataFrame(rows, FILES))
    for r in classes.collect():
        own = [x for x in rows if x[6] == r["audio"]]
        pairs = sum(x[1] < y[1] and x[0] != y[0] and x[2] != y[2] for x in own for y in own)
        assert (r["files"], r["reports"], r["evidences"], r["pairs"]) == (len(own), len({x[0] for x in own}), len({x[2] for x in own}), pairs)
    assert edges.filter("attrs['fingerprint'] = 'b'").count() == classes.filter("audio = 'b'").first()["pairs"]
