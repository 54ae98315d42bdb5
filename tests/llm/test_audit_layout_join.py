"""Filter audit, clustered layout and Jaccard join against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from casegraph.llm import filters, jaccard, layout

from test_near import brute, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, key long, z long, file long"


def frame(spark, rows):
    """rows: doc_id, text, lang, source; the other columns bear names that operators use inside."""
    return spark.createDataFrame([(*r, 1, "p", "d", 7, 7, 7) for r in rows], SCHEMA)


# -- filter audit -----------------------------------------------------------------------------------------------------
def fails(text, doc_id, least):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and least.get(text, doc_id) < doc_id,
    }


def audited(rows, labels):
    least, parts, out = {}, {}, {}
    for d, t, _, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    for d, t, _, s in rows:
        parts.setdefault(s or "", []).append((fails(t or "", d, least), d is not None and d in good, d is not None and d in toxic))
    for part, docs in parts.items():
        worth = Counter()
        for order in permutations("ABCDE"):
            live = docs
            for k, x in enumerate(order):
                gone = [r for r in live if r[0][x]]
                live = [r for r in live if not r[0][x]]
                worth[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(live), len(gone), sum(r[0][x] for r in docs) - len(gone), sum(r[0][x] and sum(r[0].values()) == 1 for r in docs), sum(r[1] for r in gone), sum(r[2] for r in gone), x]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = worth[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \n\x0b", "A", "ÄÖ ß\xa0x", "one $ two"]
    for _ in range(40):
        few = [word() for _ in range(rng.choice([5, 80]))]
        t = rng.choice([" ", "\t\n"]).join(rng.choice(few) for _ in range(rng.choice([10, 49, 50, 51, 90])))
        texts.append(t.upper() if rng.random() < 0.2 else t + rng.choice(["", "", " #"]))
    texts += texts[:20] + [texts[8]] * 15
    rows = [(rng.choice([k, k, None]) if k % 9 == 0 else k // 2 if k % 7 == 0 else k, t, "en", rng.choice(["a", "b", "", None])) for k, t in enumerate(texts)]
    return rows + rows[5:9]


def test_audit_is_that_of_all_orders(spark, monkeypatch):
    rows = audit_rows()
    labels = [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(0, 60, 2)] + [(4, None, None), (4, 0, 1), (None, 1, 1), (6, 1, 0), (6, 0, 0)]
    frames = frame(spark, rows), spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filters.audit(*frames)
    assert got.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(rows, labels)


def test_audit_of_nothing_and_slices(spark):
    assert filters.audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    long = ("ab cd  " * 400_000 + "x") * 2  # several slices
    words = long.split()
    assert filters.own_mask(long.encode(), len(long)) == (100 * len(set(words)) < 65 * len(words)) << 1
    assert filters.own_mask(b"y" * (3 << 20), 3 << 20) == 1


# -- clustered layout -------------------------------------------------------------------------------------------------
def laid_out(rows, size):
    n = len(rows)
    low = lambda v: (v is not None, v if v is not None else 0)
    cols = [[low(None if r[k] is None else r[k].encode()) for r in rows] for k in (3, 2)]
    cols += [[low(-1 if r[1] is None else len(r[1].encode())) for r in rows], [low(None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 365) for r in rows]]
    coords = list(zip(*[[16 * sum(y < x for y in c) // n for x in c] for c in cols], strict=True))
    z = [int("".join(f"{c:04b}"[b] for b in range(4) for c in cs), 2) for cs in coords]
    order = sorted(range(n), key=lambda k: (z[k], low(rows[k][0])))
    file = {k: p // size for p, k in enumerate(order)}
    inside = {}
    for k in range(n):
        inside.setdefault(file[k], []).append(coords[k])
    bounds = {f: [g(c[d] for c in cs) for d in range(4) for g in (min, max)] for f, cs in inside.items()}
    out = []
    for p, k in enumerate(order):
        q = [(c - r, c + r) for c, r in zip(coords[k], layout.REACH, strict=True)]
        touched = sum(all(b[2 * d] <= q[d][1] and b[2 * d + 1] >= q[d][0] for d in range(4)) for b in bounds.values())
        matching = sum(any(all(lo <= x <= hi for x, (lo, hi) in zip(c, q, strict=True)) for c in cs) for cs in inside.values())
        out.append((rows[k][0], z[k], p, file[k], touched, matching, ",".join(map(str, bounds[file[k]]))))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_layout_answers_as_a_scan_of_all_files(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice([None, "", "é" * rng.randint(0, 9), "x" * rng.randint(0, 40)]), rng.choice(["en", "fr", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "", None, "é"])) for k in range(150)]
    rows += [(None, "t", "en", "s0"), (None, None, None, None), *rows[:3]]
    rng.shuffle(rows)
    key = lambda r: tuple(map(repr, r))
    got = layout.layout(frame(spark, rows), size)
    assert got.dtypes == [*[(c, "bigint") for c in ("doc_id", "z", "position", "file", "files_touched", "files_matching")], ("file_bounds", "string")]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(laid_out(rows, size), key=key)


def test_layout_of_nothing_and_of_one_value(spark):
    assert layout.layout(frame(spark, [])).count() == 0
    got = layout.layout(frame(spark, [(1, "a" * 3_000_000, "en", "s")] * 5), 2).collect()
    assert [(r["z"], r["files_touched"], r["files_matching"]) for r in got] == [(0, 3, 3)] * 5


# -- Jaccard join -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("points", "tokens", "frequent"), [(64, 1 << 16, 6), (1, 1 << 16, 6), (1, 200, 1_000_000), (3, 200, 2)])
def test_join_classes_are_those_of_all_pairs(spark, monkeypatch, points, tokens, frequent):
    monkeypatch.setattr(jaccard, "LEAF_POINTS", points)
    monkeypatch.setattr(jaccard, "LEAF_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(random.Random(points + frequent), 60, 60)
    # A passage that many different documents share.
    rng = random.Random(9)
    shared = " ".join(f"p{k}" for k in range(40))
    rows += [(20_000 + k, " ".join(f"{rng.random():.9f}" for _ in range(rng.randint(5, 80))) + " " + shared) for k in range(40)]
    got = jaccard.jaccard_join(frame(spark, [(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 5, 80))


def test_pairs_of_small_trees_are_made_once(spark, monkeypatch):
    import itertools

    import numpy as np

    monkeypatch.setattr(jaccard, "TASK_POINTS", 1)  # a task for each tree
    tokens = np.arange(100, dtype=np.uint64)
    points = spark.createDataFrame([(k, 100, bytearray(jaccard.point(tokens))) for k in range(6)], "id long, n long, point binary")
    # Trees 1 to 40 have the same four members, the others share pairs with them and with each other.
    trees = {key: range(4) for key in range(1, 41)} | {50: range(1, 6), -9: (0, 5), 60: (2, 3, 5)}
    members = spark.createDataFrame([(key, k, k) for key, of in trees.items() for k in of], "key long, id long, label long")
    small = jaccard.different_trees(members)
    assert sorted((r["key"], r["id"]) for r in small.collect()) == sorted((key, k) for key in (1, 50, -9, 60) for k in trees[key])
    made = jaccard.within_leaves(small, points, jaccard.Join())
    assert "Aggregate [a#" not in made._jdf.queryExecution().optimizedPlan().toString()  # before: made for each tree, then distinct
    assert sorted(map(tuple, made.collect())) == sorted({p for of in trees.values() for p in itertools.combinations(of, 2)})


def test_join_of_odd_rows(spark):
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(400_000))  # longer than a slice
    rows = [(3, text), (None, text), (3, text), (5, text + " w"), (None, None), (7, ""), (8, "A b"), (9, "a B"), (None, "only here")]
    got = jaccard.jaccard_join(frame(spark, [(d, t, None, None) for d, t in rows])).collect()
    key = lambda r: tuple(map(repr, r))
    n = 399_996
    assert sorted(map(tuple, got), key=key) == sorted([(3, n, 3), (None, n, 3), (3, n, 3), (5, n + 1, 3), (None, 0, None), (7, 0, 7), (8, 1, 8), (9, 1, 8), (None, 1, None)], key=key)


def test_bound_never_falls_below_what_is_shared():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 1 << 62, rng.integers(1, 3000)).astype(np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate((b, a[: rng.integers(0, len(a) + 1)])))
        bound = jaccard.most_shared(np.frombuffer(jaccard.point(a), np.uint32), np.frombuffer(jaccard.point(b), np.uint32))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_linked_sets_share_a_token_of_their_prefixes():
    import numpy as np

    rng, join = np.random.default_rng(2), jaccard.Join(5, 80)
    for n in [*range(1, 30), 100, 400]:
        for _ in range(20):
            both = rng.choice(1 << 20, n, replace=False).astype(np.uint64)
            extra = int(rng.integers(0, n // 4 + 1))
            a = np.sort(both)
            b = np.unique(np.concatenate((both[extra:], rng.choice(1 << 20, int(rng.integers(0, extra + 2)), replace=False).astype(np.uint64))))
            if not len(b) or not join.plan.linked(a, b):
                continue
            frequent = np.unique(rng.choice(both, n // 2)) if n > 1 else np.zeros(0, np.uint64)
            order = rng.permutation(len(frequent))
            assert len(np.intersect1d(join.prefix(a, order, frequent), join.prefix(b, order, frequent)))


def test_overlaps_are_those_of_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(40)] + [np.array([1 << 63], np.uint64)]
    assert (jaccard.overlaps(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()
