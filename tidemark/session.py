"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: list[str] = []


def build_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, ANSI, AQE with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is configured, local mode uses a temporary one and a cluster is refused:
    executors there don't see each other's disks."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            configured = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            configured = tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table below the shared folder."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that this process made below the shared folder, once no result reads them any more."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor repeats little work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder, compressed well, as it is read once or twice, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
