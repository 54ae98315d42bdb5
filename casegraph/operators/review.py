"""Append-only decision ledgers: latest decision, hash chain, orphans, application, review queue, alerts, pseudonyms."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.functions.normalize import list_text, number_text, record_hash
from casegraph.operators.storage import numbered, saved
from casegraph.sources.reports import edge

GENESIS = "genesis"


def record(previous: dict | None, edge: str, decision: str, user: str, note: str, ts: str) -> dict:
    """The next ledger record; one writer appends it."""
    if decision not in vocab.DECISIONS:
        raise ValueError(f"unknown decision {decision}")
    if not user.strip():
        raise ValueError("a decision needs a user")
    out = {"secuencia": (previous["secuencia"] + 1) if previous else 1, "arista_id": edge, "decision": decision, "usuario": user, "observacion": note, "ts": ts, "prev_hash": previous["hash"] if previous else GENESIS}
    out["hash"] = "sha256:" + hashlib.sha256(json.dumps(out, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    return out


def link_record(previous: dict | None, a: str, b: str, action: str, user: str, reason: str, ts: str) -> dict:
    """The next manual-link record: ordered ends, no self-link, and a reason to link."""
    if a == b:
        raise ValueError("a report can't link with itself")
    if action not in ("vincular", "desvincular") or not user.strip() or (action == "vincular" and not reason.strip()):
        raise ValueError("a link needs an action, a user and a reason")
    out = {"secuencia": (previous["secuencia"] + 1) if previous else 1, "reporte_a": min(a, b), "reporte_b": max(a, b), "accion": action, "usuario": user, "motivo": reason, "ts": ts, "prev_hash": previous["hash"] if previous else GENESIS}
    out["hash"] = "sha256:" + hashlib.sha256(json.dumps(out, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    return out


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the raw record beside its fields; blank lines are skipped."""
    raw = spark.read.text(path).filter("trim(value) <> ''")
    schema = "secuencia long, arista_id string, reporte_a string, reporte_b string, decision string, accion string, usuario string, motivo string, observacion string, ts string, prev_hash string, hash string"
    return raw.select(F.col("value").alias("record"), F.from_json("value", schema).alias("r")).select("record", "r.*")


def broken_chain(ledger: DataFrame) -> DataFrame:
    """Records whose previous hash or own content hash is wrong.

    A record's predecessor is found by a join on its number, so the chain needs no single task.
    """
    before = ledger.select((F.col("secuencia") + 1).alias("secuencia"), F.col("hash").alias("expected"))
    with_before = ledger.join(before, "secuencia", "left").withColumn("expected", F.coalesce("expected", F.lit(GENESIS)))
    return with_before.withColumn("computed", record_hash(F.col("record"))).filter("prev_hash <> expected or hash <> computed").select("secuencia", "prev_hash", "expected", "hash", "computed")


def latest_decision(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Last decision of each key in ledger order, and how many it had; folds in each task.

    If the ledger names users and times, also who decided and when, and all decisions of the key in order.
    """
    more = []
    if {"usuario", "ts"} <= set(ledger.columns):
        told = F.struct(F.col(order).alias("order"), F.col("decision").alias("decision"), F.col("usuario").alias("by"), F.col("ts").alias("at"))
        more = [F.max_by("usuario", order).alias("by"), F.max_by("ts", order).alias("at"), F.array_sort(F.collect_list(told)).alias("history")]
    return ledger.groupBy(key).agg(F.max_by("decision", order).alias("decision"), F.count("*").alias("decisions"), F.max(order).alias("last"), *more)


def apply(edges: DataFrame, decisions: DataFrame, key: str = "arista_id") -> DataFrame:
    """Edges with their state: the latest decision, else the origin's first state; rejected edges aren't current.

    by, at and history come along if the decisions have them.
    """
    first = F.create_map(*[F.lit(x) for kv in vocab.FIRST_STATE.items() for x in kv])
    more = [c for c in ("by", "at", "history") if c in decisions.columns]
    out = edges.drop("state", "current", *more).join(decisions.select(key, "decision", *more), key, "left")
    state = F.coalesce("decision", F.element_at(first, F.col("origin")))
    return out.withColumn("state", state).withColumn("current", F.col("state") != "rechazada").drop("decision")


def orphans(decisions: DataFrame, edges: DataFrame, key: str = "arista_id") -> DataFrame:
    return decisions.join(edges.select(key), key, "left_anti")


def manual_links(ledger: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VINCULADO_POR_OPERADOR edges of pairs whose latest action is to link, and orphans: pairs of which a report is missing.

    ledger: secuencia, reporte_a, reporte_b, accion, usuario, motivo, ts; reports: sid.
    """
    told = F.struct("secuencia", "accion", "usuario", "motivo", "ts")
    last = ledger.groupBy("reporte_a", "reporte_b").agg(F.max(told).alias("r"), F.array_sort(F.collect_list(told)).alias("history")).filter("r.accion = 'vincular'")
    flag = lambda c, n: reports.select(F.col("sid").alias(c), F.lit(True).alias(n))
    rows = last.join(flag("reporte_a", "has_a"), "reporte_a", "left").join(flag("reporte_b", "has_b"), "reporte_b", "left")
    there = rows.filter("has_a and has_b").withColumn("reportId", F.lit(None).cast("string"))
    attrs = {"by": F.col("r.usuario"), "reason": F.col("r.motivo"), "at": F.col("r.ts"), "history": F.to_json("history")}
    edges = edge(there, ("REPORTE", F.col("reporte_a")), ("REPORTE", F.col("reporte_b")), "VINCULADO_POR_OPERADOR", F.concat(F.lit("libro:vinculos_manuales#"), "r.secuencia"), "vinculacion_manual", attrs=attrs, source=F.concat(F.lit("operador:"), "r.usuario"))
    return edges, rows.filter("has_a is null or has_b is null").select("reporte_a", "reporte_b", "r.*")


def triggers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, list(c), p) for m, (c, p) in vocab.TRIGGERS.items()], "rule string, needs array<string>, priority string")


#: Words for people.
BRINGS = {
    "identificador_atribuible": "un identificador que individualiza", "ip_atribuible": "una dirección IP atribuible con fecha y hora",
    "evidencia_con_hash": "un archivo con hash", "ubicacion_determinable": "una ubicación utilizable", "caso_con_merito": "una actuación con mérito",
}


def contributions(edges: DataFrame, about: DataFrame) -> DataFrame:
    """What each report can offer another: sid, kind, type, value, locator; a value once, by its first locator.

    Only structured relations individualise; an address counts with a time, if it is attributable or its port is known; a
    report of an active state or of the upper priorities has merit. about: sid, state, priority.
    """
    ends = F.array(*[F.struct(F.col(f"{e}_kind").alias("type"), F.col(f"{e}_value").alias("value")) for e in ("src", "dst")])
    rows = edges.select("sid", "relation", "locator", "observed_ts", "attrs", F.explode(ends).alias("e"), (F.col("dst_kind") == "UBICACION").alias("placed")).select("*", "e.*").filter("sid is not null")
    kinds = F.create_map(*[F.lit(x) for kv in vocab.ATTRIBUTABLE.items() for x in kv])
    seen = (F.col("relation") == "OBSERVADO_DESDE_IP") & F.col("observed_ts").isNotNull() & ((F.col("attrs")["attributable"] == "true") | nz.given(F.col("attrs")["port"]))
    kind = (
        F.when(F.try_element_at(kinds, F.col("relation")) == F.col("type"), "identificador_atribuible").when(F.col("type") == "EVIDENCIA", "evidencia_con_hash")
        .when((F.col("type") == "IP") & seen, "ip_atribuible").when((F.col("type") == "UBICACION") & F.col("placed") & F.col("relation").isin("GEOLOCALIZA_EN", "UBICADO_EN"), "ubicacion_determinable")
    )
    merit = F.lower("state").isin(*vocab.ACTIVE) | F.upper("priority").isin(*vocab.MERIT_PRIORITIES)
    own = about.filter(merit).select("sid", F.lit("caso_con_merito").alias("kind"), F.lit("REPORTE").alias("type"), F.col("sid").alias("value"), F.lit(STATE_LOCATOR).alias("locator"))
    return rows.withColumn("kind", kind).filter("kind is not null").groupBy("sid", "kind", "type", "value").agg(F.min("locator").alias("locator")).unionByName(own)


STATE_LOCATOR = "estado_institucional"


def alerts(links: DataFrame, about: DataFrame, brought: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reopening alerts and silenced ones.

    links: a, b, score, rules, arista_id, locator of current derived links; about: sid, state, motive; brought: sid, kind,
    value. Links under the cluster threshold or without a sustaining rule raise none. Either end that is archived may reopen
    if the other brings what its motive lacks; an unknown motive takes the default. If the other end is archived too, the
    priority is a step lower. Alerts stand by priority, then score.
    """
    strong = links.filter(F.col("score") >= vocab.CLUSTER)
    more = [c for c in ("arista_id", "locator") if c in links.columns]
    both = strong.select(F.col("a").alias("archived"), F.col("b").alias("trigger"), "score", *more).union(strong.select("b", "a", "score", *more))
    state = F.lower(F.coalesce("state", F.lit("")))
    old = about.filter(state.isin(*vocab.ARCHIVED)).select(F.col("sid").alias("archived"), F.coalesce(F.nullif(F.col("motive"), F.lit("")), F.lit("_default")).alias("motive"))
    other = about.select(F.col("sid").alias("trigger"), F.col("state").alias("trigger_state"), state.isin(*vocab.ARCHIVED).alias("also"))
    known = F.when(F.col("motive").isin(*vocab.TRIGGERS), F.col("motive")).otherwise("_default")
    kinds = brought.groupBy(F.col("sid").alias("trigger")).agg(F.collect_set("kind").alias("kinds"))
    rows = both.join(old, "archived").join(other, "trigger", "left").join(kinds, "trigger", "left")
    rows = rows.withColumn("rule", known).join(F.broadcast(triggers(links.sparkSession)), "rule")
    rows = rows.withColumn("brings", F.array_sort(F.array_intersect(F.coalesce("kinds", F.array().cast("array<string>")), "needs")))
    lower = F.when(F.col("priority") == "alta", "media").otherwise("baja")
    names = F.create_map(*[F.lit(x) for kv in BRINGS.items() for x in kv])
    said = lambda c: F.transform(c, lambda k: F.element_at(names, k))
    why = F.concat(F.lit("El reporte "), F.col("archived").cast("string"), F.lit(" está archivado; el reporte "), F.col("trigger").cast("string"), F.lit(" aporta "), list_text(said("brings")), F.lit(". Puntaje interno, no calibrado: "), number_text(F.col("score")), F.lit(". Decide una persona."))
    loud = rows.filter(F.size("brings") > 0).select("archived", "trigger", "motive", "trigger_state", F.array_join("brings", ",").alias("brings"), F.when(F.col("also"), lower).otherwise(F.col("priority")).alias("priority"), "score", *more, why.alias("explanation"))
    rank = F.when(F.col("priority") == "alta", 0).when(F.col("priority") == "media", 1).otherwise(2)
    quiet = F.concat(F.lit("El vínculo existe, pero al archivado le haría falta "), F.array_join(said("needs"), " o "), F.lit("."))
    return loud.orderBy(rank, F.desc("score"), "archived", "trigger"), rows.filter(F.size("brings") == 0).select("archived", "trigger", "motive", F.array_join("needs", ",").alias("lacks"), quiet.alias("explanation"))


def by_motive(alerted: DataFrame) -> DataFrame:
    """Archived reports with alerts, by motive."""
    return alerted.select("motive", "archived").distinct().groupBy("motive").agg(F.array_sort(F.collect_set("archived")).alias("archived"))


def pseudonyms(values: DataFrame) -> DataFrame:
    """kind, value, order to a label for each value: its kind and its rank in it.

    Ranks come from a distributed sort, so a kind with most of the values isn't numbered by one task.
    """
    first = values.groupBy("kind", "value").agg(F.min("order").alias("order"))
    all_ = saved(numbered(first, "kind", "order", "value", name="no"))
    before = all_.groupBy("kind").agg((F.min("no") - 1).alias("before"))  # a row for each kind of the vocabulary
    return all_.join(F.broadcast(before), "kind").select("kind", "value", F.concat_ws("-", "kind", (F.col("no") - F.col("before")).cast("string")).alias("label"))
