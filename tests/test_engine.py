"""Fixed keys, normalisers, text mining, the linkage of small invented reports, graph algorithms, review."""

import json
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.functions import textmine
from casegraph.operators import graph, linkage, review, similarity
from casegraph.operators.storage import saved
from casegraph.plans.build import build, violations
from casegraph.streaming import ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vocabulary():
    assert len(vocab.NODE_TYPES) == 20 and len(vocab.ORIGIN) == 33 and len(vocab.RULES) == 13
    assert not vocab.problems()
    together = 1.0
    for r in vocab.RULES:
        if r.corroborates:
            together *= 1 - r.weight
    assert 1 - together < vocab.PROPOSE


@pytest.mark.parametrize(("raw", "key"), [("011 15 5555-0101", "+541155550101"), ("+54 9 11 5555-0101", "+541155550101"), ("54 11 5555 0101", "+541155550101"), ("+1 (202) 555-0101", "+12025550101"), ("123", None), ("", None), (None, None)])
def test_phone(spark, raw, key):
    assert one(spark, nz.phone(F.lit(raw).cast("string"))) == key


def test_normalisers(spark):
    lit = F.lit
    assert one(spark, nz.alias_key(lit(" Púente_Azul47 "))) == "puenteazul47"
    assert one(spark, nz.alias_key(lit("a-1"))) is None
    assert one(spark, nz.email(lit("A.b+c@GoogleMail.com"))) == "ab@gmail.com"
    assert one(spark, nz.phone_area(lit("+541155550101"))) == "1155"
    assert tuple(one(spark, nz.ip(lit("100.64.0.9")))) == ("100.64.0.9", 4, False, True, False)
    assert one(spark, nz.ip(lit("x")))["ip"] is None
    assert one(spark, nz.ipv4_number(lit("1.2.3.4"))) == 16909060 and one(spark, nz.ipv4_number(lit("1.2.3.256"))) is None
    assert str(one(spark, nz.instant(lit("31/12/2025 23:59")))) == "2025-12-31 23:59:00"
    assert one(spark, nz.location_key(lit("a"), lit(None).cast("string"), lit(" b "))) == "a, b"
    assert [one(spark, nz.discriminance(lit(d))) for d in (1, 10)] == [1.0, 1.0] and 0.69 < one(spark, nz.discriminance(lit(30))) < 0.7
    assert one(spark, nz.number_text(lit(1234567.5))) == "1.234.567,50"
    assert one(spark, nz.list_text(F.array(lit("a"), lit("b"), lit("c")))) == "a, b y c"
    assert abs(one(spark, nz.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) - 111.19) < 0.1
    got = one(spark, nz.edge_id(*[lit(x) for x in "uvrmls"]))
    assert got.startswith("e_") and len(got) == 18


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("Contacto alternativo: +54 9 11 6000-0147", {("TELEFONO", "+541160000147")}), ("Agendá 11-6000-0147", {("TELEFONO", "+541160000147")}),
        ("Buscame como Puente_Azul47", {("ALIAS", "puenteazul47")}), ("Escribí a puenteazul47", {("ALIAS", "puenteazul47")}),
        ("Transferencias: luna.rio.47", {("ALIAS_PAGO", "lunario47")}), ("[2026-07-04 21:06:12 UTC] Reported User: hola", set()),
        ("Reported User (Profile NX-800147): hola", set()), ("se organiza afuera de PlayHub, en NexoChat", set()),
        ("agregame como Zorro.Gris_88 que te paso el link", {("ALIAS", "zorrogris88")}), ("buscame como el pibe de siempre", set()), ("expediente 990100001 en tramite", set()),
        ("hablamos con zorro88 ayer", {("ALIAS", "zorro88")}), ("agendame wh-ats.app", set()), ("12.34.56 @luna_rio", {("ALIAS", "lunario")}), ("BÚSCAME cómo rio_azul", {("ALIAS", "rioazul")}),
    ],
)
def test_text_mining(text, keys):
    assert {(k, v) for k, v, *_ in textmine.find(text)} == keys


def test_caps(spark):
    rows = [(i, "CUENTA", "one", False, "x") for i in range(101)] + [(1000 + i, "CUENTA", "many", False, "x") for i in range(150)]
    idx = linkage.index(spark.createDataFrame(rows, "sid long, kind string, value string, from_text boolean, locator string"))
    freq = linkage.frequency(idx)
    assert linkage.links(linkage.score(linkage.firings(linkage.shared(idx, freq), 251))).count() == 5050
    assert [tuple(r) for r in linkage.groups(freq).collect()] == [("CUENTA::many", "CUENTA", 150, 11175, 10000, "grupo_compacto")]


def test_text_factor(spark):
    rows = [(1, "TELEFONO", "a", True, "x"), (2, "TELEFONO", "a", False, "x"), (3, "TELEFONO", "b", True, "x"), (4, "TELEFONO", "b", True, "x"), (5, "ALIAS_PAGO", "c", True, "x"), (6, "ALIAS_PAGO", "c", True, "x")]
    idx = linkage.index(spark.createDataFrame(rows, "sid long, kind string, value string, from_text boolean, locator string"))
    scored = linkage.score(linkage.firings(linkage.shared(idx, linkage.frequency(idx)), 6))
    assert sorted((r["a"], r["score"]) for r in linkage.links(scored).collect()) == [(1, 0.765), (3, 0.6503)]
    assert [(r["a"], r["reason"]) for r in linkage.discarded(scored).collect()] == [(5, "bajo_umbral")]


def report(rid, account, device=None, alias="", city="", ip=None, ts=None, phone=None, note=None, files=()):
    person = {"id": 7, "espUserId": account, "screenName": alias, "espEstimatedLocations": {"espEstimatedLocations": [{"city": city, "countryCode": "AR"}]}, "sourceInformation": {"sourceCaptures": []}}
    captures = person["sourceInformation"]["sourceCaptures"]
    if device:
        captures.append({"captureType": "Device ID", "value": device})
    if ip:
        captures.append({"captureType": "IP Address", "value": ip, "dateTime": ts, "port": 4000})
    if phone:
        person["phones"] = {"phones": [{"value": phone}]}
    body = {"reportingEsp": {"espName": "Plaza"}, "reportedPeople": {"reportedPersons": [person]}, "uploadedFiles": list(files)}
    if note:
        body["incidentDetails"] = {"chatIncident": [{"notes": [{"value": note}]}]}
    return {"reportId": rid, "reportedInformation": body}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    secret = "[2026-01-01 10:00:00 UTC] Reported User (Profile P77): hola, contacto alternativo: +54 9 11 5555-0102"
    for r in (
        report("A1", "u1", "dev-1", "Rio.Azul", "Salto", "8.8.8.8", "2026-01-01T10:00:00Z", note=secret), report("A2", "u1", "dev-1", "rioazul", "Salto"),
        report("A3", "u9", None, "rio_azul", "Salto", phone="011 15 5555-0102"), report("A4", None, None, "", "", files=[{"md5": "ab"}, {"fileName": "x"}]), report("A5", "u5", "DEV-1", "otro77", "Colon", "no ip"),
    ):
        (folder / f"{r['reportId']}.json").write_text(json.dumps(r))
    states = folder / "estado_institucional.json"
    states.write_text(json.dumps({"A2": {"estado": "archivado", "motivo_archivo": "sin_datos_de_usuario"}, "A5": {"estado": "archivado", "motivo_archivo": "sin_archivos"}}))
    return build(spark, [str(folder)], str(states)), secret, folder


def test_reports_to_links(built):
    out, secret, _ = built
    links = {(r["a"], r["b"]): r for r in out["links"].collect()}
    assert links["A1", "A2"]["score"] == 0.99 and "R01_CUENTA" in links["A1", "A2"]["rules"]
    assert links["A1", "A5"]["score"] == 0.92 and links["A2", "A5"]["rules"] == "R02_DISPOSITIVO"
    assert "R03_TELEFONO" in links["A1", "A3"]["rules"]
    assert [(r["a"], r["b"], r["reason"]) for r in out["discarded"].collect()] == [("A2", "A3", "no_sostenido")]
    assert violations(out["edges"]).count() == 0
    assert {r["warning"] for r in out["warnings"].collect()} == {"archivo sin hash", "IP invalida"}
    assert secret not in str(out["edges"].collect()) and secret in str(out["texts"].collect())
    assert {r["first_report"]: r["reports"] for r in out["cases"].collect()} == {"A1": 4, "A4": 1}
    assert {(r["archived"], r["trigger"], r["priority"]) for r in out["alerts"].collect()} >= {("A2", "A1", "alta"), ("A2", "A5", "media")}


def test_rejection_spreads(spark, built):
    out, _, folder = built
    edge = out["links"].filter("a = 'A1' and b = 'A2'").first()["arista_id"]
    again = build(spark, [str(folder)], decisions=spark.createDataFrame([(1, edge, "validada"), (2, edge, "rechazada")], "secuencia long, arista_id string, decision string"))
    state = {(r["a"], r["b"]): r["current"] for r in again["links"].collect()}
    assert state["A1", "A2"] is False and state["A1", "A5"] is True


LINKS = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (10, 11, 1.0)]


def test_graph(spark):
    links = spark.createDataFrame(LINKS, "a long, b long, weight double")
    assert {r["v"]: r["label"] for r in graph.components(links).collect()} == {**dict.fromkeys(range(1, 7), 1), 10: 10, 11: 10}
    assert sorted(map(tuple, graph.bridges(links).collect())) == [(3, 4), (10, 11)]
    between = {r["v"]: r["betweenness"] for r in graph.betweenness(links, 8).collect()}
    assert between[1] == 0 and abs(between[3] - 2 * 6 / 42) < 1e-9
    rank = {r["v"]: r["rank"] for r in graph.pagerank(links).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and abs(rank[10] - rank[11]) < 1e-9 and rank[3] > rank[1]
    home = {r["v"]: r["community"] for r in graph.communities(links).collect()}
    assert home[1] == home[2] == home[3] != home[4] == home[5] == home[6]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert graph.components(path).select("label").distinct().count() == 1
    assert graph.omitted(links, "betweenness", 5).first()["n"] == 6


def test_ledger(spark, tmp_path):
    first = review.record(None, "e_1", "validada", "ana", "señal", "2026-01-01")
    second = review.record(first, "e_1", "rechazada", "ana", "", "2026-01-02")
    path = tmp_path / "l" / "ledger.jsonl"
    path.parent.mkdir()
    lines = [json.dumps(r, ensure_ascii=False) for r in (first, second)]
    path.write_text("\n".join([lines[0], "", lines[1]]) + "\n")
    book = review.read_ledger(spark, str(path))
    assert review.broken_chain(book).count() == 0
    assert review.latest_decision(book, "arista_id", "secuencia").first()["decision"] == "rechazada"
    q = ledger.latest(ledger.read(spark, str(path.parent))).writeStream.outputMode("complete").format("memory").queryName("book").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("book").collect()] == [("e_1", "rechazada", 2, 2)]
    path.write_text(lines[0].replace("señal", "otra") + "\n" + lines[1] + "\n")
    assert [r["secuencia"] for r in review.broken_chain(review.read_ledger(spark, str(path))).collect()] == [1]
    for bad in (("e", "x", "u"), ("e", "validada", " ")):
        with pytest.raises(ValueError):
            review.record(None, *bad, "", "")
    with pytest.raises(ValueError):
        review.link_record(None, "a", "a", "vincular", "u", "r", "")


def test_hash_neighbours(spark):
    rows = [(0, 1), (0, 2), (255, 3), (511, 4), (-1, 5), (-2, 6)]
    got = {(r["hash_a"], r["hash_b"], r["distance"]) for r in similarity.hash_neighbours(spark.createDataFrame(rows, "hash long, sid long")).collect()}
    assert got == {(0, 255, 8), (255, 511, 1), (-2, -1, 1)}


def test_tables_without_rows(spark):
    idx = linkage.index(spark.createDataFrame([], "sid long, kind string, value string, from_text boolean, locator string"))
    assert linkage.score(linkage.firings(linkage.shared(idx, linkage.frequency(idx)), 0)).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_are_scored_where_they_are_made(spark):
    rows = [(i, "CUENTA", str(i // 9), False, "x") for i in range(90)] + [(i, "DISPOSITIVO", str(i % 9), False, "y") for i in range(90)]
    idx = linkage.index(spark.createDataFrame(rows, "sid long, kind string, value string, from_text boolean, locator string"))
    scored = linkage.score(linkage.firings(linkage.shared(idx, linkage.frequency(idx)), 90))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\w+, b#", plan), "a row for each pair goes through a shuffle"
    assert scored.count() == 10 * 36 + 9 * 45  # no pair shares both


def test_spanning_links_have_the_components_of_all(spark):
    rows = []
    for i in range(150):
        rows += [(i, "TELEFONO", str(i * 7 % 90), i % 3 == 0, "x"), (i, "DISPOSITIVO", str(i * i % 31), False, "x"), (i, "ALIAS", str(i % 50), False, "x"), (i, "EMAIL", str(i * 11 % 170), i % 5 == 0, "x")]
    idx = saved(linkage.index(spark.createDataFrame(rows, "sid long, kind string, value string, from_text boolean, locator string")))
    freq = saved(linkage.frequency(idx))
    every = linkage.links(linkage.score(linkage.firings(linkage.shared(idx, freq), 150))).filter("score >= 0.7")
    every, some = ([(r["a"], r["b"]) for r in x.select("a", "b").collect()] for x in (every, linkage.spanning(idx, freq, 150)))
    assert set(some) <= set(every) and len(set(some)) < len(every)
    least = lambda pairs: reduce(lambda to, p: {v: min(to[p[0]], to[p[1]]) if x in (to[p[0]], to[p[1]]) else x for v, x in to.items()}, pairs, {i: i for i in range(150)})
    assert least(every) == least(some)


def test_components_of_a_path_and_of_a_star(spark):
    path, star = [(i, i + 1) for i in range(1, 300)], [(1000, i) for i in range(1001, 1300)]
    found = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 301)} | {i: 1000 for i in range(1000, 1300)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
