"""Tables as numbered Parquet snapshots, of which a pointer file names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, new, old) -> None:
    """Renames ``new`` over ``old`` in one step, so that there is always a pointer to read."""
    sc = spark.sparkContext
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(new, old, how)


def version(spark: SparkSession, root: str) -> int | None:
    """Number of the current snapshot; None where there is none."""
    fs, path = _fs(spark, root)
    pointer = path(f"{root}/CURRENT")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return int(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    number = version(spark, root) if at is None else at
    if number is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/v{number}")


def publish(df: DataFrame, root: str, expected: int | None) -> int:
    """Writes the next snapshot and moves the pointer to it, if the current one is still ``expected``; else RuntimeError.

    The data is complete before the pointer is renamed over, so a reader sees the old or the new table whole. One writer a table.
    """
    spark = df.sparkSession
    if version(spark, root) != expected:
        raise RuntimeError(f"{root} is no longer at {expected}")
    number = (expected or 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v{number}")
    fs, path = _fs(spark, root)
    new = path(f"{root}/CURRENT.{number}")
    stream = fs.create(new, True)
    stream.write(bytearray(str(number).encode()))
    stream.close()
    if version(spark, root) != expected:
        raise RuntimeError(f"{root} is no longer at {expected}")
    _replace(spark, new, path(f"{root}/CURRENT"))
    return number
