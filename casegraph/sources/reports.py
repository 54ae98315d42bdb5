"""Case reports (nested JSON) to nodes, edges with provenance, restricted texts, sources and warnings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.functions.textmine import mentions
from casegraph.operators.storage import saved

# The input's field names, the source prefix of its identifiers, and names that files can't have.
_VALUES = "array<struct<value:string>>"
_CAPTURE = "struct<captureType:string,value:string,valueType:string,eventName:string,dateTime:string,possibleProxy:string,port:string>"
PERSON = (
    "struct<id:string,gender:string,approximateAge:string,accountPermanentlyDisabled:boolean,accountTemporarilyDisabled:boolean,espUserId:string,"
    f"espService:string,screenName:string,screenNames:struct<screenNames:{_VALUES}>,displayNames:struct<displayNames:{_VALUES}>,"
    f"emails:struct<emails:{_VALUES}>,phones:struct<phones:{_VALUES}>,profileBio:string,ipAddress:string,sourceInformation:struct<sourceCaptures:array<{_CAPTURE}>>,"
    "espEstimatedLocations:struct<espEstimatedLocations:array<struct<city:string,region:string,countryCode:string,verified:boolean,timestamp:string>>>>"
)
INCIDENTS = ("chatIncident", "emailIncident", "webpageIncident", "peerToPeerIncident", "gamingIncident", "cellPhoneIncident", "newsgroupIncident", "otherInternetIncident", "internetIncident", "nonInternetIncident")
_INCIDENT = f"array<struct<id:string,chatServiceOrClient:string,chatRoomName:string,notes:{_VALUES}>>"
LOOKUPS = ("reportedPersonGeoLookups", "childVictimGeoLookups", "imageGeoLookups", "internetGeoLookups")
_LOOKUP = "array<struct<ipAddress:string,country:string,region:string,city:string,postalCode:string,latitude:string,longitude:string,esp:string,organization:string,types:array<string>>>"
GROUPS = (("reportedPeople", "reportedPersons", "reportado"), ("childVictims", "childVictims", "victima"), ("intendedRecipients", "intendedRecipients", "destinatario"))
SCHEMA = (
    "reportId variant, dateReceived string, reportedInformation struct<reportingEsp:struct<espName:string>,"
    "incidentSummary:struct<incidentType:string,platform:string,incidentDateTime:string>,"
    f"incidentDetails:struct<{','.join(f'{i}:{_INCIDENT}' for i in INCIDENTS)}>,"
    + ",".join(f"{g}:struct<{a}:array<{PERSON}>>" for g, a, _ in GROUPS)
    + ",uploadedFiles:array<struct<md5:string,sha1:string,fileHash:string,hash:string,fileName:string,fileType:string,industryClassification:string>>>, "
    f"automatedInformation struct<autoGeneratedNotes:struct<geoLookups:struct<{','.join(f'{x}:{_LOOKUP}' for x in LOOKUPS)}>>>, "
    "additionalNcmecInformation struct<priority:struct<priorityId:string,value:string>,ncmecClassification:string,internationalCountry:string,sentToLawEnforcement:string>, "
    "lawEnforcementContactInformation struct<lawEnforcementContacts:array<struct<agency:string,dateTimeMadeAvailable:string>>>"
)
STATES = "estado_institucional.json"
PREFIX = "ncmec:"
PROFILE = r"(Reported User|Other User)\s*\(Profile\s+(\w+)\)"
VALID_ID = r"^[A-Za-z0-9_-]{1,60}$"
RESERVED = ("con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)))
EDGE = [
    "arista_id", "src", "src_kind", "src_value", "dst", "dst_kind", "dst_value", "relation", "origin", "sid", "source_id", "locator", "method",
    "version", "confidence", "observed_ts", "attrs", "explanation",
]
VERSION = "1.0"
#: What an edge says, for people.
SAYS = {
    "EMITIDO_POR": "el prestador remitió el reporte", "CONTIENE_EVENTO": "el reporte comprende este hecho", "PARTICIPA_EN": "la transcripción identifica este perfil",
    "REPORTADO_EN": "el reporte menciona a esta persona", "USA_CUENTA": "la persona figura con esta cuenta", "ALIAS_DE": "un campo declara este nombre",
    "ASOCIADO_A_EMAIL": "un campo declara este correo", "ASOCIADO_A_TELEFONO": "un campo declara este teléfono", "OBSERVADO_DESDE_IP": "una captura registra esta dirección",
    "USA_DISPOSITIVO": "una captura registra este dispositivo", "UBICADO_EN": "la plataforma declara esta ubicación aproximada", "ASIGNADA_A": "la consulta asigna la dirección a este prestador",
    "GEOLOCALIZA_EN": "la consulta ubica la dirección de modo aproximado", "ADJUNTA": "el reporte acompaña este archivo", "PUESTO_A_DISPOSICION_DE": "el reporte se puso a disposición de este organismo",
    "MENCIONA_EMAIL": "el texto menciona este correo, sin decir de quién es", "MENCIONA_TELEFONO": "el texto menciona este teléfono, sin decir de quién es",
    "MENCIONA_ALIAS": "el texto menciona este alias, sin decir de quién es", "MENCIONA_ALIAS_PAGO": "el texto menciona este alias de pago, sin decir de quién es",
    "MENCIONA_LUGAR": "el texto restringido describe un lugar", "TIENE_HASH_PERCEPTUAL": "el manifiesto declara esta huella perceptual", "TIENE_HUELLA_AUDIO": "el manifiesto declara esta huella de audio",
    "SIMILITUD_PERCEPTUAL": "las huellas perceptuales son cercanas; no es identidad del archivo", "COINCIDE_HUELLA_AUDIO": "los manifiestos declaran la misma huella de audio",
    "SIMILAR_A": "hipótesis: las descripciones de lugar se parecen; no prueba que sea el mismo", "POSIBLE_MISMA_IDENTIDAD": "hipótesis: las dos personas usan la misma cuenta",
    "CONTRADICE": "las dos direcciones quedan demasiado lejos para el tiempo transcurrido", "IDENTIFICADO_COMO": "una persona validó que las menciones son la misma identidad",
    "VINCULADO_POR_OPERADOR": "una persona vinculó los reportes; no lo propuso el sistema",
}


# -- files ------------------------------------------------------------------------------------------------------------
#: Containers that must be objects if they are there at all; what lies under them may have any type.
CONTAINERS = ("reportedInformation", "reportedInformation.incidentSummary", "reportedInformation.incidentDetails", "additionalNcmecInformation")


def navigated(text: Column, schema: str, containers: Iterable[str] = ()) -> Column:
    """A JSON text as a struct, each value by its own path.

    What has another type than its place asks for is read if it can be (a number as text, a text that spells a number), else
    null at that place alone; a list where an object belongs, or the other way round, has nothing. Null if it is not one object, or
    if one of the containers holds anything but an object (or nothing: null, false, "", 0, []); a text that is no JSON raises an error.
    """
    all_ = F.parse_json(F.concat(F.lit("["), text, F.lit("]")))  # as a list, for what follows a value would go unseen
    only = F.try_variant_get(all_, "$[1]", "variant").isNull()
    for c in containers:
        held = F.try_variant_get(all_, f"$[0].{c}", "variant")
        plain = F.try_variant_get(held, "$", "string")
        only &= F.coalesce(F.schema_of_variant(held).rlike(r"^(OBJECT|VOID$|ARRAY<VOID>$)"), F.lit(True)) | F.coalesce(plain.isin("", "false", "0"), F.lit(False))
    return F.when(only, F.try_variant_get(all_, "$[0]", StructType.fromDDL(schema).simpleString()))


def read(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Reports of all folders; of one id the last folder's stays. Files that aren't JSON objects stop the read (Spark lists none of no bytes).

    id_type is the JSON type that the id had, path the file.
    """
    out = None
    for k, folder in enumerate(folders):
        part = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).filter(F.col("_metadata.file_name") != STATES)
        part = part.select(navigated(F.decode("content", "UTF-8"), SCHEMA, CONTAINERS).alias("r"), F.col("_metadata.file_path").alias("path"), F.lit(k).alias("folder"))
        part = part.withColumn("r", F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("not a report: "), "path")).cast(StructType.fromDDL(SCHEMA))).otherwise(F.col("r")))
        out = part if out is None else out.unionByName(part)
    return identified(out)


def given_texts(texts: DataFrame) -> DataFrame:
    """As read(), of texts with their paths (text, path) instead of files; r is null for what is no report."""
    return texts.select(navigated(F.col("text"), SCHEMA, CONTAINERS).alias("r"), "path", F.lit(0).alias("folder"))


def identified(rows: DataFrame) -> DataFrame:
    """Reports (r, path, folder) with their ids and the type of those; of one id the last folder's."""
    typed = rows.select("r.*", "path", "folder").withColumn("id_type", F.schema_of_variant("reportId")).withColumn("reportId", F.try_variant_get("reportId", "$", "string"))
    window = Window.partitionBy("reportId")
    ranked = typed.withColumn("r", F.row_number().over(window.orderBy(F.desc("folder"), "path")))
    same = F.count("*").over(Window.partitionBy("reportId", "folder")).alias("in_folder")
    return ranked.select("*", same).filter("r = 1").drop("r", "folder")


def invalid(reports: DataFrame) -> DataFrame:
    """Ids that aren't allowed, that one folder holds twice, and that differ in case only."""
    name = F.col("reportId")
    wrong = name.isNull() | ~name.rlike(VALID_ID) | ~F.col("id_type").isin("STRING", "BIGINT") | F.lower(name).isin(*RESERVED)
    reason = F.when(wrong, "id").when(F.col("in_folder") > 1, "twice")
    same = reports.groupBy(F.lower("reportId").alias("k")).agg(F.count_distinct("reportId").alias("n"), F.min("reportId").alias("reportId")).filter("n > 1")
    return reports.select("reportId", reason.alias("reason")).filter("reason is not null").union(same.select("reportId", F.lit("case").alias("reason")))


def refuse(reports: DataFrame) -> DataFrame:
    """The reports, if all of their ids are valid."""
    if bad := invalid(reports).limit(20).collect():
        raise ValueError("invalid report ids: " + ", ".join(f"{r['reportId']} ({r['reason']})" for r in bad))
    return reports


def read_states(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """sid, state, motive, date, operator from the sidecar files of folders (or given by path); later folders override."""
    kind = "map<string,struct<estado:string,motivo_archivo:string,fecha:string,operador:string>>"
    out = None
    for k, folder in enumerate([folders] if isinstance(folders, str) else folders):
        raw = spark.read.option("pathGlobFilter", STATES).text(folder, wholetext=True)
        part = raw.select(F.explode(F.from_json("value", kind)).alias("sid", "s"), F.lit(k).alias("folder"))
        out = part if out is None else out.union(part)
    last = out.groupBy("sid").agg(F.max_by("s", "folder").alias("s"))
    return last.select("sid", F.col("s.estado").alias("state"), F.col("s.motivo_archivo").alias("motive"), F.col("s.fecha").alias("state_date"), F.col("s.operador").alias("operator"))


def registry(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """Sources: source_id, kind, path, hash of the file, sid."""
    files = reports.select("reportId", "path")
    folders = [r["f"] for r in files.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
    bytes_ = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folders).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
    own = lambda p: F.regexp_replace(p, "^file:/+", "/")
    hashed = bytes_.select(own("path").alias("path"), "hash")
    return files.withColumn("path", own("path")).join(hashed, "path").select(F.concat(F.lit(PREFIX), "reportId").alias("source_id"), F.lit("reporte").alias("kind"), "path", "hash", F.col("reportId").alias("sid"))


# -- nodes and edges --------------------------------------------------------------------------------------------------
def _map(entries: dict[str, Column] | None) -> Column:
    rows = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (entries or {"": F.lit(None)}).items()]
    return F.map_from_entries(F.filter(F.array(*rows), lambda e: e["v"].isNotNull()))


def _kind(kind: str | Column) -> Column:
    if isinstance(kind, str) and kind not in vocab.NODE_TYPES:
        raise ValueError(f"unknown node type {kind}")
    return F.lit(kind) if isinstance(kind, str) else kind


def edge(
    df: DataFrame, src: tuple[str | Column, Column], dst: tuple[str | Column, Column], relation: str, locator: Column, method: str,
    confidence: float | Column | None = None, ts: Column | None = None, attrs: dict[str, Column] | None = None,
    src_facts: dict[str, Column] | None = None, dst_facts: dict[str, Column] | None = None, source: Column | None = None, label: Column | None = None,
) -> DataFrame:
    """One branch: rows with both ends, a concrete locator and, for derived relations, a confidence; facts tell of its nodes.

    df has the report's id as reportId.
    """
    origin = vocab.ORIGIN[relation]
    if (origin in ("derivada", "inferida")) != (confidence is not None):
        raise ValueError(f"{relation}: confidence belongs to derived relations")
    source = F.concat(F.lit(PREFIX), "reportId") if source is None else source
    u, v = nz.node_id(_kind(src[0]), src[1]), nz.node_id(_kind(dst[0]), dst[1])
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.filter(src[1].isNotNull() & dst[1].isNotNull() & (nz.strip(dst[1]) != "")).select(
        nz.edge_id(u, v, F.lit(relation), F.lit(method), locator, source).alias("arista_id"), u.alias("src"), _kind(src[0]).alias("src_kind"), src[1].alias("src_value"),
        v.alias("dst"), _kind(dst[0]).alias("dst_kind"), dst[1].alias("dst_value"), F.lit(relation).alias("relation"), F.lit(origin).alias("origin"), F.col("reportId").alias("sid"),
        source.alias("source_id"), locator.alias("locator"), F.lit(method).alias("method"), F.lit(VERSION).alias("version"), F.when(sure.isNotNull(), F.round(F.least(sure.cast("double"), F.lit(vocab.MOST)), 4)).alias("confidence"),
        (F.lit(None) if ts is None else ts).cast("timestamp").alias("observed_ts"), _map(attrs).alias("attrs"),
        F.concat(F.lit(SAYS[relation] + ": "), dst[1] if label is None else label).alias("explanation"), _map(src_facts).alias("src_facts"), _map(dst_facts).alias("dst_facts"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Nodes from rows of node_id, kind, value, facts (map), ord: first writers, later different values as variants."""
    base = rows.groupBy("node_id").agg(F.min_by("kind", "ord").alias("kind"), F.min_by("value", "ord").alias("value"))
    each = rows.select("node_id", "ord", F.explode("facts").alias("key", "fact")).groupBy("node_id", "key").agg(F.min_by("fact", "ord").alias("fact"), F.array_sort(F.collect_set("fact")).alias("all"))
    each = each.withColumn("others", F.array_except("all", F.array("fact"))).groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "fact")))).alias("attrs"), F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("key", "others"))), lambda e: F.size(e["others"]) > 0)).alias("variants"))
    return base.join(each, "node_id", "left")


def nodes(branches: DataFrame, about: DataFrame) -> DataFrame:
    """node_id, kind, value, attrs, variants of all ends of edges and of all reports (about: sid and columns that describe it)."""
    order = F.struct("sid", "locator", "arista_id").alias("ord")
    ends = branches.select(F.col("src").alias("node_id"), F.col("src_kind").alias("kind"), F.col("src_value").alias("value"), F.col("src_facts").alias("facts"), order)
    ends = ends.union(branches.select("dst", "dst_kind", "dst_value", "dst_facts", order))
    facts = {c: F.col(c) for c in about.columns if c not in ("sid", "ts")}
    own = about.select(nz.node_id(F.lit("REPORTE"), F.col("sid")).alias("node_id"), F.lit("REPORTE").alias("kind"), F.col("sid").alias("value"), _map(facts).alias("facts"), F.struct("sid", F.lit("").alias("locator"), F.lit("").alias("arista_id")).alias("ord"))
    return merged(own.union(ends))


def about(reports: DataFrame, states: DataFrame) -> DataFrame:
    """A row for each report: what describes it, its institutional state, and ts (when it happened)."""
    info, more = "reportedInformation.incidentSummary", "additionalNcmecInformation"
    iso = lambda c: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), nz.instant(F.col(c)).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    rows = reports.select(
        F.col("reportId").alias("sid"), F.coalesce(F.nullif(F.col(f"{more}.ncmecClassification"), F.lit("")), F.col(f"{info}.incidentType")).alias("classification"),
        F.col(f"{more}.priority.priorityId").alias("priority"), F.col(f"{more}.priority.value").alias("priority_text"), F.nullif(F.col(f"{info}.platform"), F.lit("")).alias("platform"),
        F.col(f"{more}.internationalCountry").alias("country"), iso(f"{info}.incidentDateTime").alias("incident_date"), iso("dateReceived").alias("received_date"),
        F.col(f"{more}.sentToLawEnforcement").alias("sent"), nz.instant(F.col(f"{info}.incidentDateTime")).alias("ts"),
    )
    return rows.join(states, "sid", "left")


def _people(reports: DataFrame) -> DataFrame:
    parts = None
    for group, array, role in GROUPS:
        p = reports.select("reportId", F.col("reportedInformation.reportingEsp.espName").alias("esp"), F.posexplode(f"reportedInformation.{group}.{array}").alias("i", "p"))
        p = p.withColumn("role", F.lit(role)).withColumn("at", F.concat(F.lit(f"reportedInformation.{group}.{array}["), "i", F.lit("]")))
        parts = p if parts is None else parts.unionByName(p)
    mention = F.concat("reportId", F.lit("/"), F.coalesce(F.nullif(F.col("p.id"), F.lit("")), F.concat("role", "i")))
    service = F.coalesce(F.nullif(F.col("p.espService"), F.lit("")), F.nullif(F.col("esp"), F.lit("")), F.lit("desconocido"))
    out = parts.withColumn("mention", mention).withColumn("service", service).withColumn("account", F.when(F.nullif(F.col("p.espUserId"), F.lit("")).isNotNull(), nz.account_key(F.col("service"), F.col("p.espUserId"))))
    return out.withColumn("anchor", F.coalesce("account", "mention")).withColumn("anchor_kind", F.when(F.col("account").isNull(), "PERSONA_MENCION").otherwise("CUENTA"))


def _names(people: DataFrame) -> DataFrame:
    """Declared names: locators of lists have no index, so that one alias given twice is one edge."""
    listed = lambda c, t: F.transform(F.coalesce(F.col(f"p.{c}.{c}.value"), F.array().cast("array<string>")), lambda v: F.struct(v.alias("v"), F.lit(f".{c}.{c}[].value").alias("where"), F.lit(t).alias("type")))
    one = F.array(F.struct(F.col("p.screenName").alias("v"), F.lit(".screenName").alias("where"), F.lit("screen name").alias("type")))
    return people.select("*", F.explode(F.concat(listed("displayNames", "nombre visible"), listed("screenNames", "screen name"), one)).alias("n"))


def _captures(people: DataFrame) -> DataFrame:
    """Captures with their route; an address field counts as one more capture behind the list."""
    given = F.coalesce("p.sourceInformation.sourceCaptures", F.array().cast(f"array<{_CAPTURE}>"))
    made = F.struct(F.lit("IP Address").alias("captureType"), F.col("p.ipAddress").alias("value"), *[F.lit(None).cast(t).alias(c) for c, t in (("valueType", "string"), ("eventName", "string"), ("dateTime", "string"), ("possibleProxy", "string"), ("port", "string"))])
    rows = people.select("*", F.posexplode(F.when(F.col("p.ipAddress") != "", F.concat(given, F.array(made))).otherwise(given)).alias("j", "c")).filter("c.value <> ''")
    kind = F.lower("c.captureType")
    route = F.when(kind.contains("ip"), "ip").when(kind.contains("device"), "device").when(kind.contains("phone"), "phone").when(kind.contains("email"), "email")
    return rows.withColumn("where", F.concat("at", F.lit(".sourceInformation.sourceCaptures["), "j", F.lit("]"))).withColumn("ts", nz.instant(F.col("c.dateTime"))).withColumn("route", route)


def chat_profiles(notes: DataFrame) -> DataFrame:
    """Profiles that a transcript names, each with the role it has first; notes: reportId, event, locator, esp, text."""
    pair = F.arrays_zip(F.regexp_extract_all("text", F.lit(PROFILE), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(PROFILE), F.lit(2)).alias("id"))
    said = notes.select("*", F.posexplode(pair).alias("k", "x"))
    return said.groupBy("reportId", "event", "locator", F.coalesce("esp", F.lit("desconocido")).alias("service"), F.col("x.id").alias("id")).agg(F.min_by("x.role", "k").alias("role"))


def extract(reports: DataFrame) -> dict[str, DataFrame]:
    """branches (edges with facts of their nodes), texts (restricted store) and warnings.

    Each branch is a projection of the reports; give them as a table, which Spark then reads by column.
    """
    report, info = ("REPORTE", F.col("reportId")), "reportedInformation"
    esp = F.nullif(F.col(f"{info}.reportingEsp.espName"), F.lit(""))
    out = [edge(reports, report, ("ORGANIZACION", esp), "EMITIDO_POR", F.lit(f"{info}.reportingEsp.espName"), "lectura", dst_facts={"subtype": F.lit("ESP")})]
    events = None
    for name in INCIDENTS:
        e = reports.select("reportId", esp.alias("esp"), F.posexplode(f"{info}.incidentDetails.{name}").alias("i", "e")).withColumn("name", F.lit(name))
        events = e if events is None else events.unionByName(e)
    events = events.withColumn("at", F.concat(F.lit(f"{info}.incidentDetails."), "name", F.lit("["), "i", F.lit("]"))).withColumn("event", F.coalesce(F.nullif(F.col("e.id"), F.lit("")), F.concat_ws("-", "reportId", "name", "i")))
    served = F.coalesce(F.nullif(F.col("e.chatServiceOrClient"), F.lit("")), F.col("e.chatRoomName"))
    out.append(edge(events, report, ("EVENTO", F.col("event")), "CONTIENE_EVENTO", F.col("at"), "lectura", dst_facts={"subtype": F.col("name"), "service": served}))
    notes = events.select("reportId", "esp", "event", "at", F.posexplode("e.notes").alias("j", "n")).withColumn("locator", F.concat("at", F.lit(".notes["), "j", F.lit("].value"))).withColumn("text", F.col("n.value")).filter("text <> ''")
    profiles = chat_profiles(notes)
    who = F.when(F.lower("role").startswith("reported"), "reportado").otherwise("contraparte")
    out.append(edge(profiles, ("CUENTA", nz.account_key(F.col("service"), F.col("id"))), ("EVENTO", F.col("event")), "PARTICIPA_EN", F.concat("locator", F.lit("#Profile="), "id"), "perfil_chat", attrs={"role": who}, src_facts={"esp": F.col("service"), "esp_user_id": F.col("id")}, label=F.col("id")))
    people = _people(reports)
    person, anchor = ("PERSONA_MENCION", F.col("mention")), (F.col("anchor_kind"), F.col("anchor"))
    bio = F.when(F.col("p.profileBio") != "", F.concat(F.lit("sha256:"), F.sha2("p.profileBio", 256)))
    off = F.coalesce("p.accountPermanentlyDisabled", F.lit(False)) | F.coalesce("p.accountTemporarilyDisabled", F.lit(False))
    out.append(edge(people, person, report, "REPORTADO_EN", F.col("at"), "lectura", attrs={"role": F.col("role")}, src_facts={"report": F.col("reportId"), "gender": F.col("p.gender"), "age": F.col("p.approximateAge"), "suspended": off, "bio_hash": bio}))
    out.append(edge(people, person, ("CUENTA", F.col("account")), "USA_CUENTA", F.concat("at", F.lit(".espUserId")), "lectura", dst_facts={"esp": F.col("service"), "esp_user_id": F.col("p.espUserId")}))
    names = _names(people)
    out.append(edge(names, anchor, ("ALIAS", nz.alias_key(F.col("n.v"))), "ALIAS_DE", F.concat("at", "n.where"), "lectura", attrs={"written": F.col("n.v"), "type": F.col("n.type")}, dst_facts={"written": F.col("n.v")}))
    area = lambda key: {"area": nz.phone_area(key)}
    for field, kind, relation, key in (("emails", "EMAIL", "ASOCIADO_A_EMAIL", nz.email), ("phones", "TELEFONO", "ASOCIADO_A_TELEFONO", nz.phone)):
        rows = people.select("*", F.posexplode(f"p.{field}.{field}").alias("j", "c")).withColumn("key", key(F.col("c.value")))
        out.append(edge(rows, anchor, (kind, F.col("key")), relation, F.concat("at", F.lit(f".{field}.{field}["), "j", F.lit("].value")), "lectura", dst_facts=area(F.col("key")) if kind == "TELEFONO" else None))
    captures = _captures(people)
    ips = captures.filter("route = 'ip'").withColumn("ip", nz.ip(F.col("c.value")))
    of_ip = {"version": F.col("ip.version"), "private": F.col("ip.private"), "cgnat": F.col("ip.cgnat"), "attributable": F.col("ip.attributable")}
    traits = of_ip | {"port": F.col("c.port"), "proxy": F.col("c.possibleProxy"), "event": F.col("c.eventName"), "timeless": F.col("ts").isNull(), "zone_note": F.when(F.col("ts").isNotNull() & ~nz.has_zone(F.col("c.dateTime")), "UTC")}
    out.append(edge(ips, anchor, ("IP", F.col("ip.ip")), "OBSERVADO_DESDE_IP", F.col("where"), "captura", ts=F.col("ts"), attrs=traits, dst_facts=of_ip))
    for r, kind, relation, key in (("device", "DISPOSITIVO", "USA_DISPOSITIVO", nz.strip), ("phone", "TELEFONO", "ASOCIADO_A_TELEFONO", nz.phone), ("email", "EMAIL", "ASOCIADO_A_EMAIL", nz.email)):
        rows = captures.filter(F.col("route") == r).withColumn("key", key(F.col("c.value")))
        out.append(edge(rows, anchor, (kind, F.col("key")), relation, F.col("where"), "captura", ts=F.col("ts"), attrs={"event": F.col("c.eventName")}, dst_facts=area(F.col("key")) if kind == "TELEFONO" else {"subtype": F.col("c.valueType")} if kind == "DISPOSITIVO" else None))
    places = people.select("*", F.posexplode("p.espEstimatedLocations.espEstimatedLocations").alias("j", "c"))
    out.append(edge(places, anchor, ("UBICACION", nz.location_key(F.col("c.city"), F.col("c.region"), F.col("c.countryCode"))), "UBICADO_EN", F.concat("at", F.lit(".espEstimatedLocations.espEstimatedLocations["), "j", F.lit("]")), "lectura", ts=nz.instant(F.col("c.timestamp")), attrs={"verified": F.coalesce("c.verified", F.lit(False)), "approximate": F.lit(True)}, dst_facts={"city": F.col("c.city"), "region": F.col("c.region"), "country": F.col("c.countryCode")}))
    for name in LOOKUPS:
        g = reports.select("reportId", F.posexplode(f"automatedInformation.autoGeneratedNotes.geoLookups.{name}").alias("j", "c")).withColumn("ip", nz.ip(F.col("c.ipAddress")))
        at = F.concat(F.lit(f"automatedInformation.autoGeneratedNotes.geoLookups.{name}["), "j", F.lit("]"))
        provider = F.coalesce(F.nullif(F.col("c.esp"), F.lit("")), F.nullif(F.col("c.organization"), F.lit("")))
        out.append(edge(g, ("IP", F.col("ip.ip")), ("ORGANIZACION", provider), "ASIGNADA_A", F.concat(at, F.lit(".esp")), "geolookup", confidence=0.75, src_facts=of_ip, dst_facts={"subtype": F.lit("ISP")}))
        where = {"city": F.col("c.city"), "region": F.col("c.region"), "country": F.col("c.country"), "postal_code": F.col("c.postalCode"), "lat": F.col("c.latitude"), "lon": F.col("c.longitude")}
        out.append(edge(g, ("IP", F.col("ip.ip")), ("UBICACION", nz.location_key(F.col("c.city"), F.col("c.region"), F.col("c.country"))), "GEOLOCALIZA_EN", at, "geolookup", confidence=F.when(F.col("ip.attributable"), 0.8).otherwise(0.6), attrs={"lat": F.col("c.latitude"), "lon": F.col("c.longitude"), "approximate": F.lit(True), "types": F.array_join("c.types", ",")}, dst_facts=where))
    files = reports.select("reportId", F.posexplode(f"{info}.uploadedFiles").alias("j", "f")).withColumn("at", F.concat(F.lit(f"{info}.uploadedFiles["), "j", F.lit("]"))).withColumn("h", F.coalesce(*[F.nullif(F.col(f"f.{c}"), F.lit("")) for c in ("md5", "sha1", "fileHash", "hash")]))
    out.append(edge(files, report, ("EVIDENCIA", F.col("h")), "ADJUNTA", F.col("at"), "lectura", dst_facts={"name": F.col("f.fileName"), "mime": F.col("f.fileType"), "classification": F.col("f.industryClassification")}))
    agencies = reports.select("reportId", F.posexplode("lawEnforcementContactInformation.lawEnforcementContacts").alias("j", "c"))
    out.append(edge(agencies, report, ("ORGANIZACION", F.nullif(F.col("c.agency"), F.lit(""))), "PUESTO_A_DISPOSICION_DE", F.concat(F.lit("lawEnforcementContactInformation.lawEnforcementContacts["), "j", F.lit("].agency")), "lectura", ts=nz.instant(F.col("c.dateTimeMadeAvailable")), attrs={"role": F.lit("destinatario")}, dst_facts={"subtype": F.lit("fuerza_o_ministerio_publico")}))
    said = notes.select("reportId", "locator", "text", F.lit("transcripcion_chat").alias("kind"), F.lit("EVENTO").alias("anchor_kind"), F.col("event").alias("anchor"))
    said = said.unionByName(people.filter("p.profileBio <> ''").select("reportId", F.concat("at", F.lit(".profileBio")).alias("locator"), F.col("p.profileBio").alias("text"), F.lit("bio_perfil").alias("kind"), "anchor_kind", "anchor"))
    texts = said.select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_id"), "reportId", "locator", "kind", F.length("text").alias("characters"), "text")
    mined = mentions(said.drop("kind"))
    for kind in ("EMAIL", "TELEFONO", "ALIAS", "ALIAS_PAGO"):
        facts = {"from_text": F.lit(True), "written": F.col("written")} | (area(F.col("key")) if kind == "TELEFONO" else {})
        out.append(edge(mined.filter(F.col("kind") == kind), anchor, (kind, F.col("key")), f"MENCIONA_{kind}", F.col("locator"), "mineria_texto", confidence=F.col("confidence"), attrs={"cue": F.nullif(F.col("cue"), F.lit("")), "written": F.col("written"), "from_text": F.lit(True)}, dst_facts=facts, label=F.col("written")))
    lost = files.filter("h is null").select(F.col("reportId").alias("sid"), F.col("at").alias("locator"), F.lit("archivo sin hash").alias("warning"))
    lost = lost.union(ips.filter("ip.ip is null").select("reportId", "where", F.lit("IP invalida")))
    return {"branches": together(out), "texts": texts, "warnings": lost}


def together(branches: Iterable[DataFrame]) -> DataFrame:
    out = None
    for b in branches:
        out = b if out is None else out.unionByName(b)
    return out


def edges_of(branches: DataFrame) -> DataFrame:
    """One row for each edge id: of several the last by locator and values stays, as later writers overwrite."""
    return branches.groupBy("arista_id").agg(F.max_by(F.struct(*EDGE[1:]), F.struct("locator", F.coalesce("observed_ts", F.lit(0).cast("timestamp")), "explanation")).alias("e")).select("arista_id", "e.*")


def single(branches: DataFrame) -> DataFrame:
    """As edges_of(), for branches that cost little to compute and hardly repeat an id: only repeated ids are shuffled with their rows.

    Where none repeats, the rows pass as they are, and columns that nobody reads are not computed.
    """
    rows = branches.withColumn("__id", F.xxhash64("arista_id"))
    again = saved(rows.groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select("__id"))
    if again.isEmpty():
        return branches.select(*EDGE)
    return rows.join(again, "__id", "left_anti").select(*EDGE).unionByName(edges_of(rows.join(again, "__id", "left_semi")))


def incidence(edges: DataFrame) -> DataFrame:
    """What the linkage index reads: identifier ends of each report's observed and derived edges, from fields or only from text."""
    kinds = sorted({r.kind for r in vocab.RULES})
    ends = F.array(*[F.struct(F.col(f"{e}_kind").alias("kind"), F.col(f"{e}_value").alias("value")) for e in ("src", "dst")])
    rows = edges.filter(F.col("origin").isin("observada", "derivada") & F.col("sid").isNotNull()).select("sid", F.explode(ends).alias("e"), F.col("relation").startswith("MENCIONA_").alias("from_text"), "locator", "relation")
    return rows.select("sid", "e.kind", "e.value", "from_text", "locator", "relation").filter(F.col("kind").isin(*kinds))
