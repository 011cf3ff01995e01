"""Where tables that cut lineage, stream checkpoints and sinks go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose executors are the
    driver, has a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_dir.get() if set_dir.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set: tables and checkpoints need a folder that driver and executors share (master {master})")
        at = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and lost executors cost nothing but a reread. options: the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
