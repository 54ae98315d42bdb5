"""Reports without free text and contacts, for publication; technical identifiers stay, so linkage can still be checked."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What replaces removed text, and the fields that hold it, as paths ([] for each item of a list).
GONE = "[texto original removido para publicacion]"
HEADER = re.compile(r"^(.*?\(Profile\s+\w+\))\s*:", re.IGNORECASE)
_PERSONS = ("reportedPeople.reportedPersons", "childVictims.childVictims", "intendedRecipients.intendedRecipients")
_ESP = "reportedInformation.reportingEsp.contactForLawEnforcement.contactPerson"
_OFFICER = "lawEnforcementContactInformation.lawEnforcementContacts[].officer"
_NCMEC = "additionalNcmecInformation"
REPLACE = {
    **{f"reportedInformation.{p}[].{f}": GONE for p in _PERSONS for f in ("profileBio", "physicalDescription", "vehicleDescription")},
    f"{_NCMEC}.executiveSummary.value": GONE, f"{_NCMEC}.notes.notes[].value": GONE,
    f"{_ESP}.emails.emails[].value": "contacto@esp.example", f"{_OFFICER}.emails.emails[].value": "contacto@organismo.example", f"{_OFFICER}.phones.phones[].value": "+540000000000",
}
#: Set whether they were there or not, if their holder is.
ALWAYS = {f"{_ESP}.firstName": "NOMBRE", f"{_ESP}.lastName": "REMOVIDO", f"{_OFFICER}.firstName": "NOMBRE", f"{_OFFICER}.lastName": "REMOVIDO", f"{_OFFICER}.title": "REMOVIDO"}
NOTE = "REPORTE REDACTADO: el texto libre y los datos de contacto fueron removidos. Los identificadores tecnicos se conservan para que la logica de vinculacion siga siendo verificable."


def transcript(text: str) -> str:
    """Each line's header up to its profile stays; blank lines go."""
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    return " \n".join(f"{m[1].strip()}: {GONE}" if (m := HEADER.match(line)) else GONE for line in lines)


def _holders(value: object, path: list[str]) -> Iterator[dict]:
    if not path:
        if isinstance(value, dict):
            yield value
        return
    name, many = path[0].removesuffix("[]"), path[0].endswith("[]")
    below = value.get(name) if isinstance(value, dict) else None
    for v in (below if isinstance(below, list) else []) if many else [below]:
        yield from _holders(v, path[1:])


def redacted(report: dict) -> tuple[dict, list[str]]:
    """The report without free text (a new object), and what was removed."""
    out, changes = json.loads(json.dumps(report)), []
    for name, incidents in ((out.get("reportedInformation") or {}).get("incidentDetails") or {}).items():
        for incident in incidents if isinstance(incidents, list) else []:
            for note in incident.get("notes") or []:
                if note.get("value"):
                    note["value"] = transcript(note["value"])
                    changes.append(f"incidentDetails.{name}")
    for fields, only in ((REPLACE, True), (ALWAYS, False)):
        for path, value in fields.items():
            *above, field = path.split(".")
            for holder in _holders(out, above):
                if (holder.get(field) if only else holder):
                    holder[field] = value
                    changes.append(path)
    info = out.get("reportedInformation") or {}
    out["reportedInformation"] = {**info, "additionalInformations": [{"value": NOTE}]}
    return out, changes


def redact(spark: SparkSession, folder: str) -> DataFrame:
    """path, json (redacted) and changes of each report file of a folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [redacted(json.loads(t)) for t in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([json.dumps(d, ensure_ascii=False) for d, _ in done], pa.string()), pa.array([c for _, c in done], pa.list_(pa.string()))], ["path", "json", "changes"])

    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInArrow(run, "path string, json string, changes array<string>")
