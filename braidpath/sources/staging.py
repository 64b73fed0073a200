"""Tables between the steps of a plan, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where the session names no checkpoint folder (tests, a laptop).
FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only local mode may leave it unset."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return FALLBACK_CHECKPOINT_DIR


def staged_dir(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path for a staged table."""
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove the application's staged tables; results that are still lazy read from them, so write these before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
