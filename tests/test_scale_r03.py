"""Steps that must not write, shuffle or hold more than their input needs (findings of round 3)."""

import itertools

import pytest
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.operators import graph, identity, similarity, storage, views
from casegraph.operators.storage import mark
from casegraph.plans import run_queries
from casegraph.sources import reports as source

SMOKE = "/root/testdata/sf0.001"


def branches(spark, rows):
    d = spark.createDataFrame(rows, "reportId string, person string, account string, locator string")
    known = source.edge(d, ("PERSONA_MENCION", F.concat_ws("/", "reportId", "person")), ("REPORTE", F.col("reportId")), "REPORTADO_EN", F.lit("r"), "lectura")
    return source.together([known, source.edge(d, ("PERSONA_MENCION", F.concat_ws("/", "reportId", "person")), ("CUENTA", F.col("account")), "USA_CUENTA", F.col("locator"), "lectura")])


def test_strip(spark):
    values = ["", " ", "a", " a b\t", " x ", "é", "é ", "~", "!x", "x\x1f", "\n", None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", nz.strip(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == {v: v and v.strip() for v in values}


@pytest.mark.parametrize("rows", [[("R1", "p", "k", "x"), ("R2", "p", "k", "x")], [("R1", "p", "k", "x"), ("R1", "p", "K ", "x"), ("R2", "p", "k", "x")]])
def test_single_edges(spark, rows):
    made = branches(spark, rows)
    key = lambda df: sorted(map(str, df.drop("attrs").collect()))
    assert key(source.single(made)) == key(source.edges_of(made))


def test_paths_write_nothing(spark):
    edges = source.edges_of(branches(spark, [("R1", "p", "k", "x"), ("R1", "q", "k", "x"), ("R2", "q", "m", "x")])).cache()
    wanted = spark.createDataFrame([("R1", "CUENTA::k"), ("R1", "CUENTA::k"), ("R2", "CUENTA::m"), ("R2", "CUENTA::k"), ("R1", "REPORTE::r1"), ("R9", "CUENTA::k")], "sid string, node_id string")
    before = mark()
    found = sorted((r["sid"], r["node_id"], r["hops"], r["path"]) for r in views.paths(edges, wanted).collect())
    way = ("R1", "CUENTA::k", 2, ["REPORTE::r1", "PERSONA_MENCION::r1/p", "CUENTA::k"])
    assert found == [way, way, ("R1", "REPORTE::r1", 0, ["REPORTE::r1"]), ("R2", "CUENTA::m", 2, ["REPORTE::r2", "PERSONA_MENCION::r2/q", "CUENTA::m"])]
    assert mark() == before


@pytest.mark.parametrize("name", [lambda v: v, lambda v: f"ñ{v}"])
def test_thinned(spark, monkeypatch, name):
    pairs = [(name(a), name(b)) for base in (0, 100, 200) for a, b in itertools.combinations(range(base, base + 12), 2)] + [(name(5), name(105)), (name(7), name(7))]
    links = spark.createDataFrame(pairs, ["a", "b"])
    few = graph.thinned(links.coalesce(1))
    assert few.count() == 34
    label = lambda df: sorted(map(tuple, graph.components(df).collect()))
    assert label(few) == label(links)
    monkeypatch.setattr(graph, "TOGETHER", 7)
    assert label(graph.thinned(links)) == label(links)


def test_identities_of_many_hypotheses(spark, monkeypatch):
    edges = source.edges_of(branches(spark, [(f"R{n:02}", "p", "k" if n < 12 else "m", "x") for n in range(15)]))
    seen = []
    real = graph.components
    monkeypatch.setattr(graph, "components", lambda links, *a: seen.append(links.count()) or real(links, *a))
    guessed = identity.hypotheses(edges)
    assert guessed.count() == 66 + 3
    groups, named = identity.consolidate(guessed.withColumn("state", F.lit("validada")).withColumn("by", F.when(F.col("src") < "PERSONA_MENCION::r02", "ana").otherwise("eva")).withColumn("at", F.lit("2026")))
    assert seen[0] <= 15  # before: 69
    assert sorted((len(r["mentions"]), r["reports"][0], r["who"], r["when"]) for r in groups.collect()) == [(3, "R12", ["eva"], "2026"), (12, "R00", ["ana", "eva"], "2026")]
    assert named.count() == 15


def test_pairs_of_accounts_over_the_cap(spark):
    one = spark.createDataFrame([(f"m{n}", "k") for n in range(5)] + [("m0", "j"), ("m9", "j"), ("x", "alone"), ("m1", "k")], "mention string, account string")
    got = lambda cap: sorted((r["account"], r["a"], r["b"]) for r in similarity.identity_pairs(one, cap).collect())
    assert got(9) == [("j", "m0", "m9")] + [("k", "m0", f"m{n}") for n in range(1, 5)]
    assert got(10) == [("j", "m0", "m9")] + [("k", f"m{a}", f"m{b}") for a, b in itertools.combinations(range(5), 2)]


def written(spark, since):
    return [set(spark.read.parquet(path).columns) for path in storage._MADE[since:]]


def test_dossier_pairs_write_no_scored_pairs(spark):
    before = mark()
    assert run_queries.dossier_pairs(spark, SMOKE).count()
    assert written(spark, before) and not any(c & {"a", "locators", "details"} for c in written(spark, before))


def test_locators_are_gathered_for_their_query_alone(spark):
    for name in ("link_details", "rule_use", "weights_bands", "current_links"):
        before = mark()
        getattr(run_queries, name)(spark, SMOKE)
        assert written(spark, before) and not any("locators" in c for c in written(spark, before))
    before = mark()
    run_queries.link_locators(spark, SMOKE)
    assert any("locators" in c for c in written(spark, before))
