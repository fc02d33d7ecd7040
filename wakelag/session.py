"""One session builder with the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "wakelag", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; partitions of files and shuffles sized for large inputs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset, a local
    master takes a temporary folder; a cluster is refused."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wakelag-")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: plans that use it several times compute it once."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked to be sent to every task if it has `most` rows or fewer; a larger one is joined as Spark
    sees fit."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
