"""Imports: all files in one pass, each accepted or refused by itself."""

import json

from casegraph.plans import api


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    put = lambda n, to: api.imported(spark, str(tmp_path / to), {f"f{k}": json.dumps({"reportId": f"r{k}", "reportedInformation": {}}) for k in range(n)})
    few, a = jobs(spark, "few", lambda: put(2, "few"))
    many, b = jobs(spark, "many", lambda: put(200, "many"))
    assert a == b and {r["status"] for r in few + many} == {"new"} and len(list((tmp_path / "many").iterdir())) == 200


def test_each_by_itself(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "Keep.json").write_text(json.dumps({"reportId": "Keep", "reportedInformation": {}}))
    before = (inbox / "Keep.json").read_bytes()
    files = {
        "broken": "{", "list": "[1]", "no id": "{}", "other case": json.dumps({"reportId": "KEEP"}),
        "unreadable": json.dumps({"reportId": "Keep", "reportedInformation": [1]}), "first bad": json.dumps({"reportId": "two", "reportedInformation": "text"}),
        "then good": json.dumps({"reportId": "two"}), "again": json.dumps({"reportId": "TWO"}), "odd": json.dumps({"reportId": 5, "reportedInformation": {"uploadedFiles": "none"}}),
    }
    got = {r["name"]: (r["report"], r["status"], r["reason"]) for r in api.imported(spark, str(inbox), files)}
    assert got == {
        "broken": (None, "refused", "JSON invalido"), "list": (None, "refused", "no es un objeto JSON"), "no id": (None, "refused", "reportId invalido"),
        "other case": ("KEEP", "refused", "reportId difiere solo en mayusculas de uno existente"), "unreadable": ("Keep", "refused", "no se puede leer: no es un reporte"),
        "first bad": ("two", "refused", "no se puede leer: no es un reporte"), "then good": ("two", "new", None), "again": ("TWO", "refused", "reportId repetido en el envio"), "odd": ("5", "new", None),
    }
    assert (inbox / "Keep.json").read_bytes() == before and sorted(p.name for p in inbox.iterdir()) == ["5.json", "Keep.json", "two.json"]
    assert api.imported(spark, str(inbox), {}) == []
