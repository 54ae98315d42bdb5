"""Line dedup, quality rules and URL verdicts against brute force."""

import random
import re

import duckdb
import pytest

from casegraph.llm import lines, quality, urls
from casegraph.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lines int, h string, first string, __x int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "h", None, 3) for d, t in rows], SCHEMA)


def brute_lines(rows):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        if t is None:
            out[d, t] = (0, 0, None)
            continue
        l = t.split("\n")
        gone = set()
        for i in range(len(l) - 2):
            w = tuple(l[i : i + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.setdefault(w, (d, i))
        out[d, t] = (len(l), len(gone), "\n".join(x for i, x in enumerate(l) if i not in gone))
    return out


def line_rows(rng):
    pool = ["", " ", "a b", "c", "d!", "é", "x" * 3000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "\n\n\n\n"), (3, rows[3][1]), (600, "a b\nc\nd!\n" * 400), (601, "q\n" * 300)]


def test_lines(spark):
    rows = line_rows(random.Random(4))
    got = lines.result(docs(spark, rows)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r["n_lines"], r["n_removed"], r["text"]) == want[r["doc_id"], texts[r["doc_id"]]], r["doc_id"]
    assert lines.result(docs(spark, [])).count() == 0
    con = duckdb.connect()
    documents = docs(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841
    con.register("documents", documents)
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(lines.SQL).fetchall(), key=str)


def test_line_stage_keeps_columns_and_clean_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb\nc"), (4, "z"), (None, None)]
    out = lines.stage(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, "a\nb\nc\nd"), (2, "x"), (4, "z"), (None, None)]


def brute_stats(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    real = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(6)
    phrase = [f"w{i}" for i in range(11)]
    rows = [(0, None), (1, ""), (2, " \n\t\x0b\x0c\r "), (3, "a"), (4, "a " * 9), (5, "a " * 8), (6, "# | $5 <b>&\n# | $5 <b>&\n\n \né ½ 日本\u00a0x")]
    for i in range(60):
        words = [rng.choice("abc") if i % 2 else f"v{rng.randrange(10_000)}" for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = phrase
        rows.append((10 + i, rng.choice([" ", "\n", "  "]).join(words)))
    rows.append((900, " ".join(phrase * 3000)))
    judged, field = quality.judge(docs(spark, rows), [])
    got = {r["row"][field["doc_id"]]: r for r in judged.collect()}
    for d, t in rows:
        r, want = got[d], brute_stats(t)
        assert tuple(r[s] for s in quality.STATS) == want, d
        assert r["kept"] == (not r["base_failed"]) == (want[0] >= 20 and 100 * want[4] <= 30 * want[0])


@pytest.mark.parametrize("low", [3, 63])
def test_statistics_of_texts_beyond_packed_positions(spark, monkeypatch, low):
    monkeypatch.setattr(quality, "LOW", low)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c d e f g h i j"]) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    rows.append((99, "a b c d e f g h i " * 20_000 + " ".join(f"v{i}" for i in range(100_000))))
    judged, field = quality.judge(docs(spark, rows), [])
    got = {r["row"][field["doc_id"]]: tuple(r[s] for s in quality.STATS) for r in judged.collect()}
    assert got == {d: brute_stats(t) for d, t in rows}


def test_stages_leave_clashing_columns_alone(spark):
    text = "\n".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(9))
    df = spark.createDataFrame([(1, text, 1, "t", [3], 4), (2, text + "\nx", 5, "u", [7], 8)], "doc_id long, text string, at int, t string, lines array<int>, old int")
    want = [(1, 1, "t", [3], 4), (2, 5, "u", [7], 8)]
    for out in (lines.stage(df), quality.stage(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert out.columns == df.columns
        assert sorted((r["doc_id"], r["at"], r["t"], r["lines"], r["old"]) for r in out.collect()) == want
    assert {r["doc_id"]: r["text"] for r in lines.stage(df).collect()}[2] == "x"


def test_quality_learns_an_ordered_list(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(5000)}" + ("###" if bad and rng.random() < 0.6 else "") for _ in range(60)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad if rng.random() < 0.95 else bad), 0))
    df, marks = docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(df, marks)
    assert rules and rules[0][0][0] == "symbol_share"
    kept = {r["doc_id"] for r in quality.stage(df, marks).collect()}
    assert sum(i in kept for i in range(900) if i % 3) > 590 and sum(i in kept for i in range(0, 900, 3)) < 10
    assert quality.fit(df.limit(0), marks) == [] and quality.fit(df, marks.limit(0)) == []
    assert quality.result(df.limit(0), marks.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"), ("http://example.net", "example.net", "", None, "allow"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), ("x://b.example.com/de/?q#z", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://w.org/fr/a://b", "w.org", "/fr/a://b", "org/fr/", "allow"), ("http://w.org?x=/fr/", "w.org", "", None, "allow"), ("http://É.org#/", "É.org", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "html", "x")], "page_id long, url string, html string, rule string")
    assert [tuple(r) for r in urls.judge(pages, URL_RULES, []).collect()] == [(1, host, path, rule, verdict)]


def test_url_mining_is_that_of_brute_force(spark):
    rng = random.Random(9)
    pages, labels = [], []
    for i in range(600):
        site, folder = rng.choice(["shop", "news", "casino"]), rng.choice(["en", "de"])
        pages.append((i, f"https://{site}.example.org/{folder}/{i}"))
        labels.append((i, 1, int(site == "casino" and folder == "de" and rng.random() < 0.9 or rng.random() < 0.05)))
    pages += [(9000, None), (9001, "junk")]
    p = spark.createDataFrame([(i, u, "b") for i, u in pages], "page_id long, url string, bad string")
    mined = urls.mine(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), confidence=0.6)
    bad = {d for d, _, t in labels if t}
    for left, c in mined:
        hit = [i for i, u in pages if set(left) <= set(urls.tokens(u))]
        assert abs(sum(i in bad for i in hit) / len(hit) - c) < 1e-9 and c >= 0.6
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(p, [], mined).collect()}
    for i, u in pages:
        assert verdicts[i] == ("block" if any(set(left) <= set(urls.tokens(u)) for left, _ in mined) else "allow")
    assert any(v == "block" for v in verdicts.values()) and verdicts[9000] == "allow"
    assert urls.mine(p.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == []


def test_supersets_of_url_rules_crowd_out_no_rule(spark):
    """One bad host whose tokens combine in thousands of ways, and a rule of lower confidence."""
    words = "/".join(f"w{chr(97 + k)}" for k in range(10))
    pages = [(i, f"https://a.bad.org/en/{i}/{words}") for i in range(40)] + [(i, f"https://b.good.com/en/{i}/{'gamble' if i < 60 else 'tea'}") for i in range(50, 120)]
    labels = [(i, 1, int(i < 40 or i in range(50, 57))) for i, _ in pages]
    p = spark.createDataFrame(pages, "page_id long, url string")
    mined = urls.mine(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (["path gamble"], 0.7) in mined
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(p, [], mined).collect()}
    assert all((verdicts[i] == "block") == (i < 60) for i, _ in pages)
    assert not any(set(x) < set(y) for x, _ in mined for y, _ in mined)
