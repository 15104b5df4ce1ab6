"""Files of a folder against the ledger that should know them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import matches


def files(spark: SparkSession, folder: str, name: str = r"[^/]+") -> DataFrame:
    """(path, name, bytes, modified) of the files whose whole name matches; contents are not read. Empty files are not listed by Spark."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.where(matches(F.col("name"), name))


def unknown(listed: DataFrame, leases: DataFrame) -> DataFrame:
    """Files that no lease's controlled path ends in."""
    known = leases.where("controlled_path is not null").select(F.element_at(F.split("controlled_path", "/"), -1).alias("name")).distinct()
    return listed.join(known, "name", "left_anti")
