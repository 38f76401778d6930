"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and all runs on one machine a temporary folder is made and set."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it has come out once: written to the shared folder, so that all that is made of it sees the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
