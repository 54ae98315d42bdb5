"""Decision ledgers as streams: an extension; batch and stream give the same latest decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "secuencia long, arista_id string, decision string, usuario string, observacion string, ts string, prev_hash string, hash string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files as they arrive."""
    return spark.readStream.schema(SCHEMA).json(folder)


def latest(stream: DataFrame) -> DataFrame:
    """Latest decision of each edge, in update mode; the state holds a row for each edge."""
    return stream.groupBy("arista_id").agg(F.max_by("decision", "secuencia").alias("decision"), F.max("secuencia").alias("last"), F.count("*").alias("decisions"))
