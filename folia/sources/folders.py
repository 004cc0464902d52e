"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        if not local:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = f"file://{tempfile.gettempdir()}/folia-checkpoints"
    return f"{root.rstrip('/')}/folia-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a new shared folder, read back: lineage ends here, and what was random stays as it was."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
