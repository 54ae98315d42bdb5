"""Reports with values of unexpected types: what can be read is, the rest is absent, and only broken files stop a run."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from casegraph.operators import identity
from casegraph.sources import reports as source

PERSON = {
    "id": "p", "espUserId": "u1", "screenName": "rio_azul", "emails": {"emails": [{"value": "a@example.org"}]},
    "sourceInformation": {"sourceCaptures": [{"captureType": "IP Address", "value": "8.8.8.8", "dateTime": "2026-01-01T10:00:00Z", "port": 4000, "possibleProxy": True}]},
    "espEstimatedLocations": {"espEstimatedLocations": [{"city": "Salto", "countryCode": "AR", "verified": True}]},
}
REPORT = {
    "reportId": "T", "reportedInformation": {
        "reportingEsp": {"espName": "Plaza"}, "incidentDetails": {"chatIncident": [{"id": "ev", "notes": [{"value": "Reported User (Profile P1): hola"}]}]},
        "reportedPeople": {"reportedPersons": [PERSON]}, "uploadedFiles": [{"md5": "ab"}],
    },
    "lawEnforcementContactInformation": {"lawEnforcementContacts": [{"agency": "Fuerza"}]},
}


def put(report, path, value):
    """The report with the value at a path of keys and places."""
    out = copy.deepcopy(report)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


INFO = ("reportedInformation",)
WHO = (*INFO, "reportedPeople", "reportedPersons", 0)
SEEN = (*WHO, "sourceInformation", "sourceCaptures", 0)
ALL = {"EMITIDO_POR", "CONTIENE_EVENTO", "PARTICIPA_EN", "REPORTADO_EN", "USA_CUENTA", "ALIAS_DE", "ASOCIADO_A_EMAIL", "OBSERVADO_DESDE_IP", "UBICADO_EN", "ADJUNTA", "PUESTO_A_DISPOSICION_DE"}
#: path, value, relations that are missing then.
ODD = {
    "T00": ((*SEEN, "port"), "4000", set()), "T01": ((*SEEN, "possibleProxy"), "true", set()), "T02": ((*INFO, "uploadedFiles"), "none", {"ADJUNTA"}),
    "T03": ((*WHO, "emails", "emails"), {"value": "a@example.org"}, {"ASOCIADO_A_EMAIL"}), "T04": ((*SEEN, "port"), {"n": 1}, set()), "T05": ((*SEEN, "port"), [], set()),
    "T06": ((*WHO, "sourceInformation"), "x", {"OBSERVADO_DESDE_IP"}), "T07": ((*WHO, "sourceInformation", "sourceCaptures"), {"0": 1}, {"OBSERVADO_DESDE_IP"}),
    "T08": ((*INFO, "incidentDetails"), [], {"CONTIENE_EVENTO", "PARTICIPA_EN"}), "T09": ((*INFO, "incidentDetails", "chatIncident", 0, "notes"), "x", {"PARTICIPA_EN"}),
    "T10": ((*WHO, "espUserId"), 77, set()), "T11": ((*WHO, "espEstimatedLocations", "espEstimatedLocations", 0, "verified"), "true", set()),
    "T12": (("lawEnforcementContactInformation",), 5, {"PUESTO_A_DISPOSICION_DE"}), "T13": ((*INFO, "reportingEsp"), None, {"EMITIDO_POR"}), "T14": ((*INFO, "reportedPeople", "reportedPersons"), "x", ALL - {"EMITIDO_POR", "CONTIENE_EVENTO", "PARTICIPA_EN", "ADJUNTA", "PUESTO_A_DISPOSICION_DE"}),
    "T15": (("additionalNcmecInformation",), "", set()), "T16": (("automatedInformation",), {"autoGeneratedNotes": [{"geoLookups": 1}]}, set()),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name, (path, value, _) in ODD.items():
        (folder / f"{name}.json").write_text(json.dumps(put(put(REPORT, ("reportId",), name), path, value)))
    (folder / source.STATES).write_text(json.dumps({"T00": {"estado": "archivado"}}))
    rows = source.refuse(source.read(spark, [str(folder)]))
    assert rows.count() == len(ODD)
    return source.edges_of(source.extract(rows)["branches"]).cache()


def test_each_odd_type_loses_its_own_branch_alone(found):
    got = {r["sid"]: set(r["x"]) for r in found.groupBy("sid").agg(F.collect_set("relation").alias("x")).collect()}
    assert got == {name: ALL - gone for name, (_, _, gone) in ODD.items()}


def test_ports_and_proxies_of_any_type(found):
    """A port given as text is a port, an empty list is none; a proxy given as text hides its user like the truth value."""
    got = {r["sid"]: (r["port"], r["nat"]) for r in identity.captures(found).collect()}
    assert got["T00"] == ("4000", True) and got["T01"] == ("4000", True) and got["T04"][0] == '{"n":1}'
    plain = identity.captures(found.withColumn("attrs", F.map_filter("attrs", lambda k, v: k != "proxy")))
    assert {r["nat"] for r in plain.collect()} == {False}


@pytest.mark.parametrize("text", ["{", "\n", "[1, 2]", "5", "{} {}", '{"reportId": 1, "reportedInformation": [1]}', '{"reportId": 1, "additionalNcmecInformation": "x"}'])
def test_broken_files_stop_the_run(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|not a report"):
        source.read(spark, [str(tmp_path)]).collect()
