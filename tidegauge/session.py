"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# UTC keeps day partitions and bucket starts independent of the machine; AQE is
# what sizes shuffle partitions, splits skewed join partitions and turns joins
# into broadcasts once the measured size of a side is small enough.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    # The JVM never compiles methods above 8000 bytes: wide projections run
    # faster through split functions than as one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Log text compresses well; zstd is what the fact tables are meant to use.
    "spark.sql.parquet.compression.codec": "zstd",
}


def cluster_settings(cores: int) -> dict[str, str]:
    """Sizes for a cluster with that many cores, to pass as ``extra``.

    Shuffles start with several partitions per core and are coalesced by
    adaptive execution. Scans split by file size although most queries read a
    few of some hundred columns, so splits are larger than Spark's default.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, 4 * cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "512m",
    }


def build_session(app: str = "tidegauge", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``, which the session must name."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
