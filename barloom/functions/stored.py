"""Intermediate tables: written to the folder that all executors share, so that a lost executor costs one read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where everything runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet and read back: what follows starts from the files."""
    path = f"{stored_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
