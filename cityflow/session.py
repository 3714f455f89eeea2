"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A reduce task should get about this much of a full shuffle.
SHUFFLE_BYTES = 128 * 1024**2


def get_session(app: str = "cityflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Wall-clock timestamps must not shift: all jobs run with the session zone on UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def size_shuffles(table: DataFrame) -> int:
    """Raise the session's shuffle partitions to what a full shuffle of the table needs.

    The size comes from file statistics. Adaptive execution merges the partitions
    that smaller shuffles leave nearly empty, so the setting is never lowered.
    """
    conf = table.sparkSession.conf
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // SHUFFLE_BYTES))
    conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``.

    The folder must be visible to every executor. A private temporary folder is
    only used in local mode, and only where the setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="cityflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cityflow-{name}-{uuid.uuid4().hex[:12]}"


def checkpoints(spark: SparkSession) -> None:
    """RDD checkpoints go to the shared folder, wherever the cluster has not set a place of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
