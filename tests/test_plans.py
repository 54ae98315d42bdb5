"""The queries over small invented tables, against brute force."""

import datetime
import itertools
import math
import random
from fractions import Fraction

import pytest

from casegraph.operators import graph
from casegraph.plans import queries as plans


def tables(spark, folder, orders):
    """orders: order, customer, part. Days and statuses vary, nations don't."""
    day = datetime.datetime(2020, 1, 1)
    o = [(k, c, "FO"[k % 2], day + datetime.timedelta(days=i), "1-URGENT") for i, (k, c, _) in enumerate(orders)]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, 1, p, "R", "F") for k, _, p in orders], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(c, c) for c in sorted({c for _, c, _ in orders})], "c_custkey long, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


#: Customers 1 and 2 meet through part 7 alone, 3 stands alone with two orders, 4 has one order and a part of its own.
ORDERS = [(1, 1, 10), (2, 1, 11), (3, 1, 7), (4, 2, 7), (5, 2, 12), (6, 2, 13), (7, 3, 14), (8, 3, 15), (9, 4, 16)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("tables"), ORDERS)


def brute_links(orders):
    """One customer's orders share its nation too: 1 - 0.02 * 0.92."""
    return {(a, b): 0.99 if c == d and (c, a, b) in ends(orders) else 0.9816 if c == d else 0.92 for a, c, p in orders for b, d, q in orders if a < b and (c == d or p == q)}


def ends(orders):
    return {(c, min(k for k, x, _ in orders if x == c), max(k for k, x, _ in orders if x == c)) for _, c, _ in orders}


def test_graph_has_links_of_all_kinds(spark, small):
    want = brute_links(ORDERS)
    assert {(r["a"], r["b"]): r["weight"] for r in plans.projection_whole(spark, small).collect()} == want
    label = {k: k for k, _, _ in ORDERS}
    for _ in ORDERS:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["v"]: r["label"] for r in plans.components_whole(spark, small).collect()} == {v: x for v, x in label.items() if v != 9}
    assert {(r["first_report"], r["reports"], r["links"]) for r in plans.cases_whole(spark, small).collect()} == {(1, 6, 7), (7, 2, 1)}
    assert sorted(map(tuple, plans.bridges(spark, small).collect())) == [(3, 4), (7, 8)]
    between = {r["v"]: r["betweenness"] for r in plans.betweenness(spark, small).collect()}
    assert between[3] == between[4] == 2 * 6 / (8 * 7) and between[1] == 0
    rank = {r["v"]: r["rank"] for r in plans.pagerank(spark, small).collect()}
    assert rank[3] > rank[1] and rank[4] > rank[6]
    assert len({r["community"] for r in plans.communities(spark, small).collect()}) == 3
    assert plans.degree_centrality_whole(spark, small).filter("v = 3").first()["degree"] == 3
    assert (3, 4) not in {(r["a"], r["b"]) for r in plans.adamic_adar_whole(spark, small).collect()}


def brute_betweenness(links, n):
    """Pairs of vertices by Floyd and Warshall in exact fractions; paths counted by distance, share by share."""
    near = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1 / Fraction(str(w))
    far = {u: {v: Fraction(0) if u == v else near[u].get(v) for v in near} for u in near}
    for m, u, v in itertools.product(near, repeat=3):
        if far[u][m] is not None and far[m][v] is not None and (far[u][v] is None or far[u][m] + far[m][v] < far[u][v]):
            far[u][v] = far[u][m] + far[m][v]
    paths = {}
    for s in near:
        paths[s] = {s: 1}
        for v in sorted((v for v in near if v != s and far[s][v] is not None), key=lambda v: far[s][v]):
            paths[s][v] = sum(paths[s][u] for u, w in near[v].items() if far[s][u] + w == far[s][v])
    share = dict.fromkeys(near, 0.0)
    for s, v, t in itertools.permutations(near, 3):
        if far[s][v] is not None and far[s][t] is not None and far[s][v] + far[v][t] == far[s][t]:
            share[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return {v: x / ((n - 1) * (n - 2)) for v, x in share.items()}


def test_betweenness_of_large_components(spark):
    """All vertices as sources, by tasks or in batches: equal to brute force; a sample: mostly in two errors, all in Hoeffding's bound."""
    rng = random.Random(5)
    pairs = {(rng.randrange(v), v) for v in range(1, 45)} | {tuple(sorted(rng.sample(range(45), 2))) for _ in range(40)}
    links = [(a, b, rng.choice([0.7, 0.8, 0.9, 0.95])) for a, b in sorted(pairs)] + [(100, 101, 0.9), (101, 102, 0.9)]
    table = spark.createDataFrame(links, "a long, b long, weight double")
    want = brute_betweenness(links, 60)
    for most, rows in ((100, 1), (2, 1_200)):
        got = {r["v"]: r for r in graph.betweenness(table, 60, most, rows=rows).collect()}
        assert set(got) == set(want) and all(abs(got[v]["betweenness"] - x) < 1e-9 and abs(got[v]["error"]) < 1e-9 for v, x in want.items())
        assert got[3]["pivots"] == 45 and got[100]["pivots"] == 3
    alone = spark.createDataFrame([(3,), (500,)], "v long")
    sample = {r["v"]: r for r in graph.betweenness(table, 60, 10, alone.union(spark.createDataFrame([(v,) for v in want if v != 3], "v long")), exact=10, pivots=30).collect()}
    assert sample[500]["betweenness"] == sample[500]["error"] == sample[500]["pivots"] == 0 and sample[3]["pivots"] == 30
    off = {v: abs(sample[v]["betweenness"] - x) for v, x in want.items()}
    assert max(off.values()) < 45 * 43 / (59 * 58) * math.sqrt(math.log(2e6) / 60)
    assert sum(x < 2 * sample[v]["error"] + 1e-9 for v, x in off.items()) > 0.8 * len(off) and max(r["error"] for r in sample.values()) > 0


def test_betweenness_without_links(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    assert graph.betweenness(none, 0).count() == 0
    assert [tuple(r) for r in graph.betweenness(none, 1, vertices=spark.createDataFrame([(4,)], "v long")).collect()] == [(4, 0.0, 0.0, 0)]


def test_pagerank_query_converges(spark, tmp_path):
    """A path of orders, joined by customers and parts in turn; ranks of plain power iteration to the end."""
    folder = tables(spark, tmp_path, [(2 * c + k, c, c + k) for c in range(1, 6) for k in (0, 1)])
    near = {}
    for r in plans.projection_whole(spark, folder).collect():
        near.setdefault(r["a"], {})[r["b"]] = near.setdefault(r["b"], {})[r["a"]] = r["weight"]
    want = dict.fromkeys(near, 1 / len(near))
    for _ in range(400):
        want = {v: 0.15 / len(near) + 0.85 * sum(want[u] * w / sum(near[u].values()) for u, w in ws.items()) for v, ws in near.items()}
    got = {r["v"]: r["rank"] for r in plans.pagerank(spark, folder).collect()}
    assert len(near) == 10 and sum(abs(got[v] - want[v]) for v in want) < 6e-6


def test_short_texts_have_hashes(spark, tmp_path):
    texts = ["a bb", "a bb", "a " * 63 + "bb", "a " * 60 + "bb bb bb bb", "", None, "bb a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        w = text.split(" ")
        h = 0
        for j in range(max(64, len(w))):
            h ^= len(w[j % len(w)]) % 2 << j % 64
        return h

    groups = {}
    for d, t in enumerate(texts):
        if t is not None:
            groups.setdefault(brute(t), []).append(d)
    want = {tuple(sorted((m[0], n[0]))): x for h, m in groups.items() for g, n in groups.items() if h < g and (x := (h ^ g).bit_count()) <= 8}
    got = {tuple(sorted((r["sid_a"], r["sid_b"]))): r["distance"] for r in plans.phash_neighbours_whole(spark, str(tmp_path)).collect()}
    assert got == want == {(2, 3): 3}


def test_scored_links_raise_alerts(spark, small):
    """Orders 3 and 4 share only a part; every order brings ip_atribuible, even ones are archived."""
    rows = plans.alerts(spark, small).select("archived", "trigger", "score").union(plans.alerts_silenced(spark, small).selectExpr("archived", "trigger", "null")).collect()
    want = {(x, y) for a, b in brute_links(ORDERS) for x, y in ((a, b), (b, a)) if x % 2 == 0}
    assert {(r["archived"], r["trigger"]) for r in rows} == want and len(rows) == len(want) and (4, 3) in want


def test_bridges_of_large_components(spark):
    rng = random.Random(3)
    pairs = {(v, rng.randrange(max(0, v - 6), v)) for v in range(1, 60)} | {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(8)}
    links = spark.createDataFrame([(b, a, 0.9) for a, b in sorted(pairs)] + [(100, 101, 0.9), (101, 102, 0.9), (100, 102, 0.9)], "a long, b long, weight double")
    want = sorted(map(tuple, graph.bridges(links).collect()))
    assert len(want) > 5 and sorted(map(tuple, graph.bridges(links, 3).collect())) == want


def modularity(links, home):
    double = 2 * sum(w for _, _, w in links)
    strength = {}
    for a, b, w in links:
        for v in (a, b):
            strength[home[v]] = strength.get(home[v], 0) + w
    return sum(2 * w for a, b, w in links if home[a] == home[b]) / double - sum(x * x for x in strength.values()) / double**2


def one_by_one(links):
    """Vertices in turn go where modularity, counted anew for each try, is highest, until none gains; then whole communities."""
    home = {v: v for a, b, _ in links for v in (a, b)}
    while True:
        before = modularity(links, home)
        for group in ([{v} for v in home], [{v for v in home if home[v] == c} for c in sorted(set(home.values()))]):
            for members in group:
                where = {home[v] for a, b, _ in links for u, v in ((a, b), (b, a)) if u in members}
                tries = [home | dict.fromkeys(members, c) for c in sorted(where)]
                home = max([home, *tries], key=lambda h: modularity(links, h))
        if modularity(links, home) < before + 1e-9:
            return home


def test_communities(spark):
    """Six cliques of five in a ring, and planted groups: no worse than moves one by one; whole cliques stay together."""
    rng = random.Random(8)
    ring = [(5 * c + i, 5 * c + j, 0.9) for c in range(6) for i in range(5) for j in range(i + 1, 5)] + [(0, 25, 0.9)] + [(5 * c, 5 * c + 5, 0.9) for c in range(5)]
    planted = [(a, b, rng.choice([0.7, 0.99])) for a in range(48) for b in range(a + 1, 48) if rng.random() < (0.55 if a // 12 == b // 12 else 0.03)]
    for links, least in ((ring, 0.6), (planted, 0.4)):
        home = {r["v"]: r["community"] for r in graph.communities(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
        assert set(home) == {v for a, b, _ in links for v in (a, b)} and all(c == min(v for v, x in home.items() if x == c) for c in home.values())
        assert modularity(links, home) >= max(least, modularity(links, one_by_one(links)) - 1e-9)
    assert graph.communities(spark.createDataFrame([], "a string, b string, weight double")).count() == 0


def test_graph_by_tasks_and_by_rounds(spark):
    """Components a task each and over all tasks give the same: members, ranks, betweenness, bridges; communities as good."""
    rng = random.Random(9)
    pairs = {(rng.randrange(max(0, v - 9), v), v) for v in range(1, 60)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)}
    links = [(a, b, rng.choice([0.7, 0.8, 0.9, 0.95])) for a, b in sorted(pairs)] + [(100, 101, 0.9), (101, 102, 0.9)]
    table = spark.createDataFrame(links, "a long, b long, weight double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.components(table)) == rows(graph.components(table, finish=0)) == [(v, 0) for v in range(60)] + [(v, 100) for v in (100, 101, 102)]
    ends = spark.createDataFrame([(v,) for v in [*range(60), 100, 101, 102, 500]], "v long")
    one, two = rows(graph.pagerank(table, ends)), rows(graph.pagerank(table, ends, most=1))
    assert [v for v, _ in one] == [v for v, _ in two] and sum(abs(x - y) for (_, x), (_, y) in zip(one, two, strict=True)) < 1e-5
    assert abs(sum(x for _, x in one) - 1) < 1e-5
    sample = [rows(graph.betweenness(table, 64, 2, ends, exact=10, pivots=20, edges=e)) for e in (0, 1_000)]
    for (v, *x), (w, *y) in zip(*sample, strict=True):
        assert v == w and all(abs(p - q) < 1e-9 for p, q in zip(x, y, strict=True))
    assert rows(graph.bridges(table)) == rows(graph.bridges(table, most=1))
    double = 2 * sum(w for _, _, w in links)

    def quality(home):
        mass = {}
        for a, b, w in links:
            for v in (a, b):
                mass[home[v]] = mass.get(home[v], 0.0) + w
        return sum(2 * w for a, b, w in links if home[a] == home[b]) / double - sum(m * m for m in mass.values()) / double**2

    here, wide = (quality(dict(rows(graph.communities(table, most=m)))) for m in (None, 1))
    assert here > 0.3 and here > wide - 0.03
