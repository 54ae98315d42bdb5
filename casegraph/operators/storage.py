"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only in local mode, where all is one process, a temporary one takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="casegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df to the shared folder and rereads it: later branches don't recompute it, a lost executor costs its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/casegraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Into how many parts so many rows go: what a task holds stays the same as tables grow, and no core idles on small ones."""
    return max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // each))


def mark() -> int:
    """How many tables saved() has written and not yet deleted; what comes later can be cleared by itself."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Deletes what saved() wrote since a mark, but for its last tables; no result that reads it may be needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stop = len(_MADE) - but_last
    gone, _MADE[since:stop] = _MADE[since:stop], []
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:  # noqa: ANN002
    """df with its rows' numbers (from 1) in an order of columns that tells all rows apart.

    The order is a distributed sort; numbers are each part's first number, from counts of the parts, plus the place in it.
    """
    parts = saved(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = parts.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
