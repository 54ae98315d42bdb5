"""What a person does with a run: decide, link, unlink, import and remove reports, look up. One writer appends to ledgers."""

from __future__ import annotations

import json
import os
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import review, views
from casegraph.operators.storage import saved
from casegraph.sources import reports as source

# Limits of an import.
MOST_FILES, MOST_BYTES = 200, 12 << 20


def _now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def _last(path: Path) -> dict | None:
    if not path.exists():
        return None
    lines = [x for x in path.read_text(encoding="utf-8").splitlines() if x.strip()]
    return json.loads(lines[-1]) if lines else None


def _append(path: str, make) -> dict:  # noqa: ANN001
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    record = make(_last(file))
    with file.open("a", encoding="utf-8") as out:
        out.write(json.dumps(record, ensure_ascii=False) + "\n")
    return record


def decide(run: dict[str, DataFrame], ledger: str, edge: str, decision: str, user: str, note: str = "", force: bool = False) -> dict:
    """Appends a decision on an edge that is there and reviewable; rejecting an observation must be forced."""
    row = views.reviewable(run["edges"]).filter(F.col("arista_id") == edge).select("origin").first()
    if row is None:
        raise ValueError(f"no reviewable edge {edge}")
    if row["origin"] == "observada" and decision == "rechazada" and not force:
        raise ValueError("an observation is rejected only by force")
    return _append(ledger, lambda before: review.record(before, edge, decision, user, note, _now()))


def _pair(run: dict[str, DataFrame], ledger: str, a: str, b: str, action: str, user: str, reason: str) -> dict:
    there = run["about"].filter(F.col("sid").isin(a, b)).count()
    if there < len({a, b}):
        raise ValueError("both reports must be part of the run")
    return _append(ledger, lambda before: review.link_record(before, a, b, action, user, reason, _now()))


def link(run: dict[str, DataFrame], ledger: str, a: str, b: str, user: str, reason: str) -> dict:
    return _pair(run, ledger, a, b, "vincular", user, reason)


def unlink(run: dict[str, DataFrame], ledger: str, a: str, b: str, user: str, reason: str = "") -> dict:
    return _pair(run, ledger, a, b, "desvincular", user, reason)


def unify(run: dict[str, DataFrame], ledger: str, a: str, b: str, user: str, note: str = "") -> dict:
    """Validates the hypothesis that two mentions are one identity."""
    row = run["identities"].filter((F.least("src_value", "dst_value") == min(a, b)) & (F.greatest("src_value", "dst_value") == max(a, b))).select("arista_id").first()
    if row is None:
        raise ValueError("no hypothesis joins these mentions")
    return decide(run, ledger, row["arista_id"], "validada", user, note)


def existing(*paths: str) -> list[str]:
    return [p for p in paths if Path(p).exists()]


def audit(spark: SparkSession, *ledgers: str) -> DataFrame | None:
    """Broken records of ledgers, by path."""
    out = None
    for path in ledgers:
        part = review.broken_chain(review.read_ledger(spark, path)).withColumn("ledger", F.lit(path))
        out = part if out is None else out.unionByName(part)
    return out


def queue(run: dict[str, DataFrame], origin: str | None = None, rows: int = vocab.CLI_ROWS) -> DataFrame:
    return views.queue(run["edges"], origin, rows)


def show(run: dict[str, DataFrame], edge: str) -> DataFrame:
    return run["edges"].filter(F.col("arista_id") == edge)


def state(run: dict[str, DataFrame]) -> dict[str, int]:
    """Counts for a status page."""
    return {"reports": run["about"].count(), "links": run["links"].filter("current").count(), "pending": run["queue"].count(), "alerts": run["alerts"].count()}


def _refusal(text: str, have: dict[str, str], seen: set[str]) -> tuple[dict | None, str | None, str | None]:
    """A text as JSON, its report's id, and why it can't be taken (null: as far as its own text and the names tell, it can)."""
    try:
        body = json.loads(text)
    except ValueError:
        return None, None, "JSON invalido"
    if not isinstance(body, dict):
        return None, None, "no es un objeto JSON"
    rid = body.get("reportId")
    name = None if rid is None else str(rid)
    if isinstance(rid, bool) or not isinstance(rid, str | int) or not re.match(source.VALID_ID, name) or name.lower() in source.RESERVED:
        return body, name, "reportId invalido"
    if name.casefold() in seen:
        return body, name, "reportId repetido en el envio"
    return body, name, None if have.get(name.casefold(), name) == name else "reportId difiere solo en mayusculas de uno existente"


def _unreadable(spark: SparkSession, texts: dict[str, str]) -> dict[str, str]:
    """Reasons of those reports (id to JSON) that the run could not read: one job finds what is no report, one extracts the rest."""
    if not texts:
        return {}
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    try:
        read = source.given_texts(rows)
        bad = {r["path"]: "no se puede leer: no es un reporte" for r in read.filter("r is null").select("path").collect()}
        source.extract(saved(source.identified(read.filter("r is not null"))))["branches"].write.format("noop").mode("overwrite").save()
        return bad
    except Exception as error:  # noqa: BLE001  the reader tells what is wrong; the halves find whose fault it is
        if len(texts) == 1:
            return {k: f"no se puede leer: {type(error).__name__}" for k in texts}
    half, items = len(texts) // 2, list(texts.items())
    return _unreadable(spark, dict(items[:half])) | _unreadable(spark, dict(items[half:]))


def imported(spark: SparkSession, inbox: str, files: dict[str, str]) -> list[dict]:
    """Puts reports (name to JSON text) into the inbox folder, each by itself: name, report, status (new, replaced, refused), reason.

    All are read together as the run reads them, in a fixed number of jobs (more only if reading one fails altogether), before
    the good ones take their places, each at once; what fails leaves what was there. Of one id in several files the first
    that the run can read is taken.
    """
    if len(files) > MOST_FILES or sum(len(t.encode()) for t in files.values()) > MOST_BYTES:
        raise ValueError(f"at most {MOST_FILES} files and {MOST_BYTES >> 20} MiB at a time")
    folder = Path(inbox)
    folder.mkdir(parents=True, exist_ok=True)
    have = {p.stem.casefold(): p.stem for p in folder.glob("*.json") if p.name != source.STATES}
    trial = {name: _refusal(text, have, set()) for name, text in files.items()}
    texts = {name: json.dumps(body, ensure_ascii=False) for name, (body, _, reason) in trial.items() if reason is None}
    bad = _unreadable(spark, texts)
    out, seen, parts = [], set(), []
    for name, text in files.items():
        _, rid, reason = _refusal(text, have, seen)
        reason = reason or bad.get(name)
        status = "refused" if reason else "replaced" if rid.casefold() in have else "new"
        if reason is None:
            seen.add(rid.casefold())
            part = folder / f".{rid}.part"
            part.write_text(texts[name], encoding="utf-8")
            parts.append((part, folder / f"{rid}.json"))
        out.append({"name": name, "report": rid, "status": status, "reason": reason})
    for part, place in parts:
        os.replace(part, place)
    return out


def removed(inbox: str, report: str) -> bool:
    """Takes a report out of the inbox; a version in another folder of the run comes back."""
    if not re.match(source.VALID_ID, report):
        raise ValueError("invalid report id")
    path = Path(inbox) / f"{report}.json"
    there = path.exists()
    path.unlink(missing_ok=True)
    return there
