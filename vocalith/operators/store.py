"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, as in tests, a temporary folder, but on a cluster an error, as that would be a folder of one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def folder(spark: SparkSession) -> str:
    """A new folder below ``root``."""
    return f"{root(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that no later loss recomputes what came before."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root(df.sparkSession))
    return df.checkpoint(eager=True)
