"""Multimedia manifests (declared metadata of files; binaries are never opened) to edges, files and warnings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.sources.reports import edge, navigated, together

# The input's field names.
SCHEMA = (
    "fileDetails array<struct<reportId:string,fileId:string,originalFileName:string,uploadedToEspTimestamp:string,"
    "originalFileHash:array<struct<hashType:string,value:string>>,details:array<struct<nameValuePair:array<struct<name:string,value:string>>>>>>"
)
METHOD = "analisis_multimedia"


def sha256_of(hashes: Column) -> Column:
    """The first SHA-256 of 64 hexadecimal digits among hashType / value pairs, in lower case."""
    good = F.filter(hashes, lambda h: (F.replace(F.upper(h["hashType"]), F.lit("-"), F.lit("")) == "SHA256") & F.lower(nz.strip(h["value"])).rlike("^[0-9a-f]{64}$"))
    return F.lower(nz.strip(F.get(good, F.lit(0))["value"]))


def traits(details: Column) -> Column:
    """All name / value pairs in order, names in lower case, blank ones left out."""
    flat = F.flatten(F.transform(F.coalesce(details, F.array().cast("array<struct<nameValuePair:array<struct<name:string,value:string>>>>")), lambda d: F.coalesce(d["nameValuePair"], F.array().cast("array<struct<name:string,value:string>>"))))
    pairs = F.transform(flat, lambda p: F.struct(F.lower(nz.strip(p["name"])).alias("name"), nz.strip(p["value"]).alias("value")))
    return F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != ""))


def perceptual(pairs: Column) -> Column:
    """The first 64-bit perceptual hash (16 hexadecimal digits, a leading 0x aside); the second name counts if the first is absent."""
    named = lambda n: F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: F.regexp_replace(F.lower(p["value"]), "^0x", ""))
    some = F.when(F.size(named("perceptual_hash")) > 0, named("perceptual_hash")).otherwise(named("phash"))
    return F.get(F.filter(some, lambda v: v.rlike("^[0-9a-f]{16}$")), F.lit(0))


def audio(pairs: Column) -> Column:
    """The first fingerprint of sound."""
    return F.get(F.filter(pairs, lambda p: p["name"].contains("audio") & (p["name"].contains("fingerprint") | p["name"].contains("huella"))), F.lit(0))["value"]


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of manifest (its number), path, source, details; and warnings of paths that aren't there."""
    found, lost = [], []
    for k, path in enumerate(paths):
        try:
            raw = spark.read.format("binaryFile").load(path)
            found.append(raw.select(F.lit(k).alias("manifest"), F.col("_metadata.file_path").alias("path"), navigated(F.decode("content", "UTF-8"), SCHEMA)["fileDetails"].alias("fileDetails"), F.sha2("content", 256).alias("hash")))
        except AnalysisException:
            lost.append((path, None, "manifiesto inexistente"))
    none = spark.createDataFrame([], f"manifest int, path string, {SCHEMA}, hash string")
    warnings = spark.createDataFrame(lost, "path string, locator string, warning string")
    return together(found or [none]).withColumn("source", F.concat(F.lit("multimedia:"), F.substring("hash", 1, 16))), warnings


def files(manifests: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each file of a known report (sid); warnings of the others."""
    rows = manifests.select("manifest", "path", "source", F.posexplode("fileDetails").alias("i", "d")).withColumn("locator", F.concat(F.lit("fileDetails["), "i", F.lit("]")))
    rows = rows.withColumn("pairs", traits(F.col("d.details"))).withColumn("sha", sha256_of(F.col("d.originalFileHash"))).withColumn("reportId", F.col("d.reportId"))
    known = rows.join(reports.select(F.col("sid").alias("reportId")), "reportId", "left_semi")
    unknown = rows.join(reports.select(F.col("sid").alias("reportId")), "reportId", "left_anti").select("path", "locator", F.concat(F.lit("reportId ausente o no ingerido: "), F.coalesce("reportId", F.lit(""))).alias("warning"))
    file_id = F.coalesce(F.nullif(F.col("d.fileId"), F.lit("")), F.concat_ws("-", "reportId", "i"))
    evidence = F.coalesce(F.concat(F.lit("sha256:"), "sha"), F.concat(F.lit("archivo:"), "reportId", F.lit(":"), file_id))
    hex_ = perceptual(F.col("pairs"))
    mime = F.get(F.filter("pairs", lambda p: p["name"] == "media_type"), F.lit(0))["value"]
    return known.select(
        "reportId", F.struct("manifest", "i").alias("ord"), "locator", F.concat("source", F.lit(":"), "i").alias("source"), file_id.alias("file_id"), evidence.alias("evidence"), "sha",
        F.coalesce(F.nullif(F.col("d.originalFileName"), F.lit("")), file_id).alias("name"), mime.alias("mime"), hex_.alias("phash"), F.conv(hex_, 16, -10).cast("long").alias("hash"),
        audio(F.col("pairs")).alias("audio"), nz.instant(F.col("d.uploadedToEspTimestamp")).alias("ts"),
    ), unknown


def branches(found: DataFrame) -> DataFrame:
    """Edges of the manifests' files: attached to the report, with a perceptual hash, with a fingerprint of sound."""
    of = {"name": F.col("name"), "mime": F.col("mime"), "sha256": F.col("sha"), "file_id": F.col("file_id"), "metadata_only": F.lit(True)}
    report, evidence, source = ("REPORTE", F.col("reportId")), ("EVIDENCIA", F.col("evidence")), F.col("source")
    return together([
        edge(found, report, evidence, "ADJUNTA", F.col("locator"), METHOD, ts=F.col("ts"), attrs={"file_id": F.col("file_id"), "metadata_only": F.lit(True)}, dst_facts=of, source=source, label=F.col("name")),
        edge(found, evidence, ("HASH_PERCEPTUAL", F.col("phash")), "TIENE_HASH_PERCEPTUAL", F.concat("locator", F.lit(".details.perceptual_hash")), METHOD, dst_facts={"bits": F.lit(64)}, source=source),
        edge(found, evidence, ("HUELLA_AUDIO", F.col("audio")), "TIENE_HUELLA_AUDIO", F.concat("locator", F.lit(".details.audio_fingerprint")), METHOD, source=source),
    ])
