"""Session settings, checkpointing and shared scratch storage.

Nothing in the library relies on executor-local state: lineage is cut with ``DataFrame.checkpoint``
(reliable storage), never with a local checkpoint, so a lost executor only costs recomputation.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a ``local`` master may fall back to a temporary folder of this machine (tests, laptops).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tickloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one job's tables."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written for itself. Results that still read it are lost: call it when they are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into reliable storage. Use where a result feeds several later branches."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run within remove their shuffle files when they end; else these stay until the driver happens to collect its
    garbage. For jobs whose results are written down (``materialized``) or collected, each frame run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialized(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a result that several branches read as a parquet table in shared storage and read it back.

    Besides cutting the lineage this keeps column pruning and gives the planner real sizes, so a join
    side is broadcast only when its written size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
