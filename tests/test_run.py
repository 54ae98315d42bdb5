"""A whole run over invented reports, manifests and ledgers: every stage against values worked out by hand."""

import json
import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from casegraph import cli, sinks
from casegraph.operators import dossier, pseudonyms, review, views
from casegraph.plans import api, docs
from casegraph.plans.build import build
from casegraph.sources import redact
from casegraph.sources import reports as source

PERSON = "reportedInformation.reportedPeople.reportedPersons[0]"


def report(rid, account=None, priority=None, when=None, notes=(), bio=None, **person):
    people = {"id": person.pop("pid", None), "espUserId": account, "profileBio": bio, **person}
    info = {"reportingEsp": {"espName": "Plaza"}, "incidentSummary": {"platform": "Plaza", "incidentType": "tipo", "incidentDateTime": when}, "reportedPeople": {"reportedPersons": [people]}}
    if notes:
        info["incidentDetails"] = {"chatIncident": [{"id": f"ev-{rid}", "notes": [{"value": n} for n in notes]}]}
    return {"reportId": rid, "reportedInformation": info, "additionalNcmecInformation": {"priority": {"priorityId": priority}, "ncmecClassification": f"clase {rid}"}}


def file(rid, number, phash=None, audio=None, sha=None):
    pairs = [{"name": n, "value": v} for n, v in (("Perceptual_Hash", phash), ("audio fingerprint", audio), ("media_type", "image/png")) if v]
    hashes = [{"hashType": "SHA-256", "value": sha}] if sha else []
    return {"reportId": rid, "fileId": f"f{number}", "originalFileName": f"n{number}.png", "originalFileHash": hashes, "details": [{"nameValuePair": pairs}]}


CHAT = "[2026-01-01 10:00:00 UTC] Reported User (Profile P1): un galpon con mural azul frente a la plaza\n[2026-01-01 10:01:00 UTC] Other User (Profile P2): mi casa con grafiti"
REPORTS = [
    report("A1", "u1", "3", "2026-01-01T10:00:00Z", [CHAT], pid="p1"), report("A2", "u1", "3", "2026-01-01T10:30:00Z", bio="Escribime a zorro_88, tel +54 9 11 5555-0199", pid="p2"),
    report("A3", "u1", "1", "2026-03-01T10:00:00Z", pid="p3"), report("B1", bio="vivo en un galpon rojo con mural, cerca de la plaza", pid="p4"), report("B2", pid="p5", emails={"emails": [{"value": " X.y+z@gmail.com "}]}),
    report("B3", pid="p6"), report("C1", pid="p7", displayNames={"displayNames": [{"value": "Rio Azul"}]}), report("C2", pid="p8", screenName="rio-azul", approximateAge="30"), report("D1", "u7", pid="p9"),
    report("V1", pid="v1", ipAddress="2001:db8::1"), report("V2", pid="v2", ipAddress="fe80::1"),
]
MANIFEST = {"fileDetails": [
    file("A3", 1, "0x00000000000000ff"), file("B1", 2, "00000000000001ff"), file("B2", 3, audio="son-1"), file("B3", 4, audio="son-1"), file("A1", 5, "00000000000000ff"),
    file("A1", 6, sha="ab" * 32), file("B2", 7, sha="AB" * 32), file("Z9", 8), file("D1", 9, phash="no"),
]}
STATE = {"A2": {"estado": "Archivado", "motivo_archivo": "sin_datos_de_usuario", "fecha": "2026-02-01", "operador": "ana"}, "A1": {"estado": "archivado", "motivo_archivo": "sin_archivos"}, "D1": {"estado": "archivado"}, "A3": {"estado": "en_analisis"}}


def put(folder, reports):
    for r in reports:
        (folder / f"{r['reportId']}.json").write_text(json.dumps(r))


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "reports").mkdir()
    put(folder / "reports", REPORTS)
    (folder / "reports" / source.STATES).write_text(json.dumps(STATE))
    (folder / "manifest.json").write_text(json.dumps(MANIFEST))
    return folder


@pytest.fixture(scope="module")
def run(spark, base):
    return build(spark, [str(base / "reports")], manifests=[str(base / "manifest.json"), str(base / "none.json")])


@pytest.fixture(scope="module")
def reviewed(spark, base, run):
    """The same run after decisions: A1-A2 rejected, both hypotheses of p1 validated, C1-D1 linked and a missing report."""
    ledger, links = str(base / "state" / "decisions.jsonl"), str(base / "state" / "links.jsonl")
    pair = run["links"].filter("a = 'A1' and b = 'A2'").first()["arista_id"]
    for a, b in (("A1/p1", "A2/p2"), ("A1/p1", "A3/p3")):
        api.unify(run, ledger, a, b, "ana")
    api.decide(run, ledger, pair, "validada", "ana")
    api.decide(run, ledger, pair, "rechazada", "eva", "no")
    api.link(run, links, "D1", "C1", "eva", "mismo expediente")
    api.link(run, links, "A1", "B2", "eva", "x")
    api.unlink(run, links, "B2", "A1", "eva")
    with pytest.raises(ValueError, match="reports"):
        api.link(run, links, "A1", "nope", "eva", "x")
    with pytest.raises(ValueError, match="force"):
        api.decide(run, ledger, run["edges"].filter("origin = 'observada'").first()["arista_id"], "rechazada", "eva")
    assert api.audit(spark, ledger, links).count() == 0
    gone = review.link_record(json.loads(open(links).read().splitlines()[-1]), "A1", "gone", "vincular", "eva", "x", "2026-01-01T00:00:00+00:00")
    with open(links, "a") as out:
        out.write(json.dumps(gone) + "\n")
    return build(spark, [str(base / "reports")], decisions=review.read_ledger(spark, ledger), manual=review.read_ledger(spark, links), manifests=[str(base / "manifest.json")])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_nodes_and_sources(run, base):
    node = {r["node_id"]: r for r in run["nodes"].collect()}
    one = node["REPORTE::a2"]["attrs"]
    assert one["classification"] == "clase A2" and one["priority"] == "3" and one["platform"] == "Plaza" and one["incident_date"] == "2026-01-01T10:30:00+00:00"
    assert one["state"] == "Archivado" and one["motive"] == "sin_datos_de_usuario" and one["state_date"] == "2026-02-01" and one["operator"] == "ana"
    assert node["PERSONA_MENCION::a2/p2"]["attrs"]["bio_hash"].startswith("sha256:") and node["PERSONA_MENCION::c2/p8"]["attrs"]["age"] == "30"
    assert node["ALIAS::rioazul"]["variants"] == {"written": ["rio-azul"]} and node["EMAIL::xy@gmail.com"]["kind"] == "EMAIL"
    assert {"IP::2001:db8::1", "IP::fe80::1"} <= set(node) and run["index"].filter("kind = 'IP' and df > 1").count() == 0
    import hashlib

    own = {r["sid"]: r["hash"] for r in run["sources"].filter("kind = 'reporte'").collect()}
    assert own["A1"] == "sha256:" + hashlib.sha256((base / "reports" / "A1.json").read_bytes()).hexdigest() and len(own) == len(REPORTS)
    assert run["violations"].count() == 0
    text = run["edges"].collect()
    assert "galpon con mural" not in str(text) and "galpon" in str(run["texts"].collect())


def test_mentions_keep_their_anchor_and_confidence(run):
    found = {(r["relation"], r["src"], r["dst"], r["confidence"], r["attrs"].get("cue")) for r in run["edges"].filter("relation like 'MENCIONA_%' and sid = 'A2'").collect()}
    assert found == {("MENCIONA_ALIAS", "CUENTA::plaza/u1", "ALIAS::zorro88", 0.74, "contacto"), ("MENCIONA_TELEFONO", "CUENTA::plaza/u1", "TELEFONO::+541155550199", 0.8, None)}
    profile = {(r["src"], r["attrs"]["role"]) for r in run["edges"].filter("relation = 'PARTICIPA_EN'").collect()}
    assert profile == {("CUENTA::plaza/p1", "reportado"), ("CUENTA::plaza/p2", "contraparte")}


def test_manifests(run):
    assert rows(run["media_warnings"].filter("locator is not null"), "locator", "warning") == [("fileDetails[7]", "reportId ausente o no ingerido: Z9")]
    assert {r["warning"] for r in run["media_warnings"].collect()} >= {"manifiesto inexistente"}
    near = run["edges"].filter("relation = 'SIMILITUD_PERCEPTUAL'")
    assert rows(near, "src_value", "dst_value", "confidence") == [("archivo:A3:f1", "archivo:A1:f5", 0.99), ("archivo:A3:f1", "archivo:B1:f2", 0.9844), ("archivo:B1:f2", "archivo:A1:f5", 0.9844)]
    assert rows(run["edges"].filter("relation = 'COINCIDE_HUELLA_AUDIO'"), "src_value", "dst_value", "confidence") == [("archivo:B2:f3", "archivo:B3:f4", 0.86)]
    links = {(r["a"], r["b"]): r for r in run["links"].collect()}
    assert links["A3", "B1"]["rules"] == "R11_PHASH_SIMILAR" and links["A3", "B1"]["score"] == 0.8072
    assert links["A1", "A3"]["rules"] == "R01_CUENTA,R11_PHASH_SIMILAR" and links["B2", "B3"]["rules"] == "R12_HUELLA_AUDIO"
    assert links["A1", "B2"]["rules"] == "R05_EVIDENCIA" and run["nodes"].filter("node_id = 'EVIDENCIA::sha256:" + "ab" * 32 + "'").count() == 1


def test_places(run):
    """The other user's house is none of the report's; both reports share structure, feature and reference."""
    place = run["nodes"].filter("kind = 'LUGAR_MENCION'").collect()
    tags = {r["attrs"]["tags"] for r in place}
    assert tags == {"color:azul,estructura:deposito,rasgo:mural,referencia:plaza", "color:rojo,estructura:deposito,rasgo:mural,referencia:plaza"}
    assert rows(run["edges"].filter("relation = 'SIMILAR_A'"), "confidence") == [(round(0.8 / 0.92, 4),)]
    pair = run["links"].filter("a = 'A1' and b = 'B1'").first()
    assert pair["rules"] == "R11_PHASH_SIMILAR,R13_CONTEXTO_LUGAR"


def test_links(run):
    links = {(r["a"], r["b"]): r["relation"] for r in run["links"].collect()}
    assert links["A1", "A2"] == "POSIBLE_DUPLICADO_DE" and links["A1", "A3"] == "COINCIDE_CON"
    assert rows(run["discarded"], "a", "b", "rules", "reason") == [("C1", "C2", "R08_ALIAS", "no_sostenido")]
    assert rows(run["cases"], "case", "reports", "links")[0] == ("L001", 6, 7) and run["members"].count() == len(REPORTS)
    assert {r["case"] for r in run["cases"].collect()} == {"L001", "RC1", "RC2", "RD1", "RV1", "RV2"}


def test_alerts(run):
    """A2 misses a user's data, A1 files, D1 has no motive: what the linked reports bring; A3 is active and of upper priority."""
    got = {(r["archived"], r["trigger"]): (r["priority"], r["brings"]) for r in run["alerts"].collect()}
    assert got["A2", "A1"] == ("media", "identificador_atribuible") and got["A2", "A3"] == ("alta", "identificador_atribuible")
    assert got["A1", "A3"] == ("alta", "evidencia_con_hash") and ("A1", "A2") not in got
    assert [r["archived"] for r in run["silenced"].filter("trigger = 'A2'").collect()] == ["A1"]
    order = [("alta", "media", "baja").index(r["priority"]) for r in run["alerts"].collect()]
    assert order == sorted(order)


def test_coverage_and_metrics(run):
    of = {r["sid"]: r for r in run["coverage"].collect()}
    assert of["C1"]["detail"] == {"ALIAS": 1} and of["C1"]["linkable"] and of["D1"]["platform"] == "Plaza"
    degree = {r["v"]: r["degree"] for r in run["degree"].collect()}
    assert degree["C1"] == 0 and degree["B3"] == 1 and len(degree) == len(REPORTS)
    rank = {r["v"]: r["rank"] for r in run["pagerank"].collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["C1"] == rank["D1"] < rank["B3"]
    assert {r["v"]: r["betweenness"] for r in run["betweenness"].collect()}["B2"] > 0 and rows(run["bridges"], "a", "b") == [("A1", "B2"), ("B2", "B3")]
    places = {(r["metric"], r["place"]): r for r in run["positions"].collect()}
    assert [places["bridge", k]["v"] + places["bridge", k]["w"] for k in (1, 2)] == ["A1B2", "B2B3"]
    for metric, value, of in (("degree", "centrality", "degree"), ("pagerank", "rank", "pagerank"), ("betweenness", "betweenness", "betweenness")):
        best = sorted(((-r[value], r["v"]) for r in run[of].collect()))[:10]
        assert [places[metric, k]["v"] for k in range(1, len(best) + 1)] == [v for _, v in best] and (metric, 11) not in places
    assert rows(run["candidates"], "a", "b", "score") == [("C1", "C2", 1.4427)]


def test_review(reviewed):
    link = reviewed["links"].filter("a = 'A1' and b = 'A2'").first()
    assert link["state"] == "rechazada" and not link["current"] and link["by"] == "eva" and [h["decision"] for h in link["history"]] == ["validada", "rechazada"]
    assert rows(reviewed["manual"], "src_value", "dst_value") == [("C1", "D1")] and rows(reviewed["manual_orphans"], "reporte_b") == [("gone",)]
    assert {"C1", "D1"} == {r["sid"] for r in reviewed["members"].collect() if r["case"] == "L002"}
    one = reviewed["unified"].collect()
    assert len(one) == 1 and one[0]["reports"] == ["A1", "A2", "A3"] and one[0]["who"] == ["ana"]
    assert reviewed["edges"].filter("relation = 'IDENTIFICADO_COMO'").count() == 3 and reviewed["identities"].filter("state = 'pendiente'").count() == 1
    assert rows(reviewed["alerts"].filter("archived = 'A2'"), "trigger") == [("A3",)]
    assert reviewed["orphans"].count() == 0 and reviewed["rejected"].count() == 1
    assert rows(reviewed["candidates"], "a", "b") == [("C1", "C2")] and {r["side"] for r in reviewed["support"].collect()} == {"a", "b"}
    assert {(r["a"], r["b"]): r["relation"] for r in views.current_link(reviewed["links"], reviewed["projection"].filter("manual")).collect()}["C1", "D1"] == "VINCULADO_POR_OPERADOR"


def test_views(run, reviewed):
    reached = views.reports_of(reviewed["nodes"], reviewed["edges"])
    identity = reviewed["unified"].first()["identity"]
    assert rows(reached.filter(F.col("node_id") == f"IDENTIDAD::{identity}"), "sid") == [("A1",), ("A2",), ("A3",)]
    assert views.entities(run["nodes"], views.reports_of(run["nodes"], run["edges"])).first()["reports"] > 1
    way = views.paths(run["edges"], run["about"].filter("sid = 'A1'").select("sid", F.lit("CUENTA::plaza/u1").alias("node_id"))).first()
    assert way["path"] == ["REPORTE::a1", "PERSONA_MENCION::a1/p1", "CUENTA::plaza/u1"] and way["hops"] == 2
    proof = views.link_evidence(run["firings"], run["edges"]).filter("a = 'A1' and b = 'A2'")
    assert {(r["side"], r["relation"]) for r in proof.collect()} == {("a", "USA_CUENTA"), ("b", "USA_CUENTA"), ("b", "MENCIONA_ALIAS"), ("b", "MENCIONA_TELEFONO")}
    assert views.found(run["nodes"], reached, "RIO", kinds=["ALIAS"]).count() == 1 and views.shown_links(run["links"], 0.95).count() == 3
    assert views.queue(run["edges"]).first()["origin"] == "inferida" and views.reviewable(reviewed["edges"]).filter("origin = 'afirmada'").count() == 0
    case = views.in_case(reached, reviewed["members"])
    assert case.filter("node_id = 'CUENTA::plaza/u1'").select("case").collect() == [("L001",)]
    assert views.neighbours(run["edges"]).filter("node_id = 'CUENTA::plaza/u1' and relation = 'USA_CUENTA'").first()["neighbours"] == 3


def test_viewer_and_commands(spark, base, reviewed, capsys):
    shown = views.viewer(reviewed)
    identity = reviewed["unified"].first()["identity"]
    assert {r["shown"] for r in shown["nodes"].filter("node_id in ('PERSONA_MENCION::a1/p1', 'PERSONA_MENCION::a2/p2')").collect()} == {f"IDENTIDAD::{identity}"}
    assert shown["nodes"].filter("node_id = 'CUENTA::plaza/u1'").first()["reports"] == ["A1", "A2", "A3"] and shown["evidence"].filter("a = 'B2' and b = 'B3'").count() == 2
    where = ["--reports", str(base / "reports"), "--state", str(base / "state")]
    assert cli.main([*where, "audit"], spark) == 0 and "secuencia" in capsys.readouterr().out
    assert cli.parser().parse_args([*where, "link", "B1", "D1", "--user", "eva"]).command == "link"


def test_vocabulary_tables(tmp_path):
    path = tmp_path / "doc.md"
    path.write_text("# x\n\n" + docs.tables())
    assert not docs.stale(str(path)) and "| R06_IP_VENTANA | IP | 0.72 | no | sí |" in docs.tables()
    path.write_text("# x")
    assert docs.stale(str(path))


def test_dossier(spark, run, reviewed):
    whole = dossier.build(reviewed)
    small = dossier.trim(whole, spark.createDataFrame([("B3",)], "sid string"))
    assert rows(small["links"], "a", "b") == [("B2", "B3")] and rows(small["cases"], "case") == [("L001",)] and small["discarded"].count() == small["manual"].count() == 0
    all_ = {r["band"]: r["links"] for r in whole["weights"].collect()}
    assert all_["all"] == sum(n for b, n in all_.items() if b != "all")
    labels = review.pseudonyms(dossier.sensitive(run["nodes"]))
    text = dossier.payload({"reports": whole["reports"].select("sid", "identifiers")})
    secret, again = dossier.pseudonymised({"reports": whole["reports"].select("sid", "identifiers")}, run["nodes"])
    assert sorted(again.collect()) == sorted(labels.collect())
    said, plain = ("\n".join(r["json"] for r in x.orderBy("json").collect()) for x in (secret, text))
    assert "plaza/u1" in plain and "plaza/u1" not in said and "xy@gmail.com" not in said and "CUENTA-" in said
    assert sorted(r["json"] for r in pseudonyms.restored(secret, "json", labels).collect()) == sorted(plain.split("\n"))


def test_sinks(spark, run, tmp_path):
    body = json.loads(open(sinks.graph_json(run, str(tmp_path / "g.json"))).read())
    assert len(body["nodes"]) == run["nodes"].count() and len(body["edges"]) == run["edges"].count() and body["meta"]["summary"]["node:REPORTE"] == len(REPORTS)
    tree = ElementTree.parse(sinks.graphml(run, str(tmp_path / "g.graphml")))  # noqa: S314  our own file
    assert len(tree.findall(".//{*}node")) == len(body["nodes"]) and len(tree.findall(".//{*}edge")) == len(body["edges"])
    assert "## 8. Cola de revisión" in open(sinks.markdown(run, str(tmp_path / "r.md"))).read()
    sinks.narratives(run, str(tmp_path / "cases"))
    assert "A1 y A2" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "cases" / "case=L001")).collect())
    sinks.tables({"texts": run["texts"], "links": run["links"]}, str(tmp_path / "t"), str(tmp_path / "secret"))
    assert spark.read.parquet(str(tmp_path / "secret" / "texts")).count() == 3 and not (tmp_path / "t" / "texts").exists()


def test_import_and_remove(spark, tmp_path):
    inbox = tmp_path / "inbox"
    good = {"reportId": 77, "reportedInformation": {}}
    done = api.imported(spark, str(inbox), {"a": json.dumps(good), "b": "{", "c": json.dumps({"reportId": True}), "d": json.dumps({"reportId": "con"}), "e": json.dumps(good), "f": json.dumps({"reportId": "k1", "reportedInformation": [1]})})
    assert [d["status"] for d in done] == ["new", "refused", "refused", "refused", "refused", "refused"] and sorted(p.name for p in inbox.iterdir()) == ["77.json"]
    assert api.imported(spark, str(inbox), {"a": json.dumps(good)})[0]["status"] == "replaced"
    assert api.removed(str(inbox), "77") and not api.removed(str(inbox), "77") and not list(inbox.iterdir())


@pytest.mark.parametrize(("extra", "why"), [({"x.json": {"reportId": 1.5}}, "id"), ({"x.json": {"reportId": True}}, "id"), ({"x.json": {"reportId": "nul"}}, "id"), ({"x.json": {"reportId": "A"}, "y.json": {"reportId": "a"}}, "case"), ({"x.json": {"reportId": "A"}, "y.json": {"reportId": "A"}}, "twice")])
def test_bad_ids_stop_a_run(spark, tmp_path, extra, why):
    for name, body in extra.items():
        (tmp_path / name).write_text(json.dumps(body))
    assert {r["reason"] for r in source.invalid(source.read(spark, [str(tmp_path)])).collect()} == {why}
    with pytest.raises(ValueError, match="invalid report ids"):
        source.refuse(source.read(spark, [str(tmp_path)]))


def test_redaction(spark, tmp_path):
    r = report("A1", notes=[CHAT], bio="secreto")
    r["lawEnforcementContactInformation"] = {"lawEnforcementContacts": [{"agency": "x", "officer": {"firstName": "N", "emails": {"emails": [{"value": "n@x.org"}]}}}]}
    put(tmp_path, [r])
    got = redact.redact(spark, str(tmp_path)).first()
    out = json.loads(got["json"])
    lines = out["reportedInformation"]["incidentDetails"]["chatIncident"][0]["notes"][0]["value"].split("\n")
    assert lines[0].strip() == f"[2026-01-01 10:00:00 UTC] Reported User (Profile P1): {redact.GONE}" and "galpon" not in got["json"] and "secreto" not in got["json"] and "n@x.org" not in got["json"]
    assert out["reportedInformation"]["reportingEsp"] == {"espName": "Plaza"} and "incidentDetails.chatIncident" in got["changes"]
