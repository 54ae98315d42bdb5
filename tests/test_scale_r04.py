"""Findings of round 4: lists of captures stay off the driver, graph queries don't expand what is linked throughout."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import graph, linkage
from casegraph.operators.storage import saved
from casegraph.plans import queries as plans

CAPTURES = [("IP::1", 1, 0, "80", False, "c1"), ("IP::1", 2, 3600, "80", True, "c2"), ("IP::1", 2, 7200, None, False, "c3"), ("IP::1", 3, None, "80", False, "c4")]


def test_captures_are_not_broadcast(spark):
    seen = spark.createDataFrame(CAPTURES, "node_id string, sid long, s long, port string, nat boolean, locator string").withColumn("ts", F.timestamp_seconds("s"))
    idx = linkage.index(seen.select("sid", F.lit("IP").alias("kind"), F.lit("1").alias("value"), F.lit(False).alias("from_text"), "locator"))
    pairs = linkage.shared(idx, linkage.frequency(idx))
    near = linkage.nearest_captures(pairs.select("node_id", "a", "b"), seen)
    assert {(r["a"], r["b"]): (r["micros"], r["ports"], r["nat"]) for r in near.collect()} == {(1, 2): (3600 * 10**6, True, True), (1, 3): (None,) * 3, (2, 3): (None,) * 3}
    windows = spark.createDataFrame([("IP::1", 2)], "node_id string, hours int")
    fired = linkage.ip_firings(pairs, seen, windows, 3)
    assert {(r["a"], r["b"]): r["rule"] for r in fired.collect()} == {(1, 2): "R06_IP_VENTANA", (1, 3): "R07_IP_SUELTA", (2, 3): "R07_IP_SUELTA"}
    assert fired._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2


@pytest.fixture(scope="module")
def compact(spark):
    """A random graph of accounts, devices (some known from text), and common dates: all links, and groups with the rest."""
    r = random.Random(3)
    seen = [(n, kind, f"{kind[0]}{r.randrange(k)}", text and r.random() < 0.1) for n in range(160) for kind, k, text in (("CUENTA", 45, False), ("DISPOSITIVO", 40, True), ("TELEFONO", 60, False), ("ALIAS", 9, False), ("CUENTA", 400, False))]
    idx = saved(linkage.index(spark.createDataFrame(seen, "sid long, kind string, value string, from_text boolean").withColumn("locator", F.lit("x"))))
    freq = saved(linkage.frequency(idx))
    manual = spark.createDataFrame([(0, 1), (7, 3), (5, 90), (200, 201)], "a long, b long")
    every = saved(graph.projection(linkage.links(linkage.score(linkage.firings(linkage.shared(idx, freq), 160))), manual))
    whole, scored = linkage.compact(idx, freq, 160)
    links = saved(graph.projection(linkage.links(scored), manual))
    assert whole.count() and links.count() < every.count() / 2
    vertices = spark.createDataFrame([(n,) for n in range(230)], "v long")
    return every, links, whole, graph.components(every), vertices


def test_compact_has_every_link(spark, compact):
    every, links, whole, labels, _ = compact
    for net in (True, False):
        rows = graph.grouped(links, whole, labels, net)
        pairs = rows.select("label", F.posexplode("at").alias("i", "a"), "at", "weight").select("a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("b"), "weight")
        got = pairs.groupBy("a", "b").agg((F.sum if net else F.max)("weight").alias("weight"), F.count("*").alias("n"))
        assert {(x["a"], x["b"]): round(x["weight"], 9) for x in got.collect()} == {(x["a"], x["b"]): round(x["weight"], 9) for x in every.collect()}


@pytest.mark.parametrize("most", [None, 0])
def test_pagerank_of_groups(spark, compact, monkeypatch, most):
    every, links, whole, labels, vertices = compact
    want = {r["v"]: r["rank"] for r in graph.pagerank(every, vertices, tolerance=1e-12, rounds=200).collect()}
    rounds = []
    monkeypatch.setattr(graph, "saved", lambda df, *a: rounds.append("q" in df.columns) or saved(df, *a))
    got = {r["v"]: r["rank"] for r in graph.pagerank(links, vertices, labels=labels, whole=whole, most=most).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-6
    assert abs(sum(got.values()) - 1) < 1e-9 and sum(rounds) <= 25
    rounds.clear()
    got = {r["v"]: r["rank"] for r in graph.pagerank(every, vertices, most=most).collect()}
    assert max(abs(got[v] - want[v]) for v in want) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9 and sum(rounds) <= 25


@pytest.mark.parametrize("members", [None, 0])
def test_betweenness_of_groups(spark, compact, members):
    every, links, whole, labels, vertices = compact
    kept = {"vertices": vertices, "labels": labels, "exact": 20, "pivots": 12}
    rows = lambda df: sorted(map(tuple, df.collect()))
    want, got = rows(graph.betweenness(every, 230, 2, **kept)), rows(graph.betweenness(links, 230, whole=whole, **kept, **({} if members is None else {"members": members})))
    assert len(got) == 230 and any(x[1] for x in got)
    for (v, *x), (w, *y) in zip(want, got, strict=True):
        assert v == w and all(abs(p - q) < 1e-9 for p, q in zip(x, y, strict=True))


def test_a_link_as_heavy_as_its_group(spark):
    """Paths count once though a link is no heavier than the group of its pair."""
    whole = spark.createDataFrame([([1, 2, 3], 0.9), ([3, 4], 0.9), ([2, 4], 0.9)], "at array<long>, weight double")
    links = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, weight double")
    every = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.9), (3, 4, 0.9), (2, 4, 0.9)], "a long, b long, weight double")
    labels = graph.components(every)
    rows = lambda df: sorted((r["v"], round(r["betweenness"], 9)) for r in df.collect())
    assert rows(graph.betweenness(links, 4, labels=labels, whole=whole)) == rows(graph.betweenness(every, 4))


@pytest.mark.parametrize("offers", [graph.OFFERS, 50])
def test_communities_of_groups(spark, compact, monkeypatch, offers):
    every, links, whole, labels, _ = compact
    monkeypatch.setattr(graph, "OFFERS", offers)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.communities(links, labels=labels, whole=whole)) == rows(graph.communities(every))


def test_cases_without_caps(spark, monkeypatch):
    """Identifiers over their cap, some of them in several accounts or from text, give the cases that all of their pairs give."""
    r = random.Random(4)
    seen = [(n, kind, f"{kind[0]}{r.randrange(k)}", text and r.random() < 0.05) for n in range(300) for kind, k, text in (("CUENTA", 90, False), ("CUENTA", 400, True), ("DISPOSITIVO", 11, False), ("UBICACION", 3, False), ("ALIAS", 12, False))]
    idx = saved(linkage.index(spark.createDataFrame(seen, "sid long, kind string, value string, from_text boolean").withColumn("locator", F.lit("x"))))
    manual, reports = spark.createDataFrame([(0, 1), (7, 3)], "a long, b long"), spark.createDataFrame([(n,) for n in range(310)], "sid long")

    def cases(caps):
        monkeypatch.setattr(vocab, "PAIR_CAPS", caps)
        span, pairs, blocks, members = linkage.uncapped(idx, saved(linkage.frequency(idx)), 1000)
        links = saved(graph.projection(pairs, manual))
        every = graph.all_cases(graph.components(span.union(manual)), links, reports, graph.Implied(blocks, members, links))[0].select("case", "first_report", "reports", "links")
        return sorted(map(tuple, every.collect())), links.count(), members.count()

    want, rows, none = cases(dict.fromkeys(vocab.PAIR_CAPS, 10**9))
    got, fewer, some = cases(dict(vocab.PAIR_CAPS, CUENTA=3, DISPOSITIVO=200, UBICACION=1, ALIAS=1))
    assert got == want and fewer < rows and not none and some


def test_all_cases_has_no_cap():
    assert "possible_pairs <= cap" not in plans.SQL["all_cases"] and "possible_pairs <= cap" in plans.SQL["cases_whole"]
