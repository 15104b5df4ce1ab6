"""Segments as JSON lines: one object a record, keys in order, NULLs kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import canonical_json

ANNOTATIONS = T.StructType([T.StructField("audio_event", T.StringType()), T.StructField("emotion", T.StringType())])
SCHEMA = T.StructType([
    T.StructField("annotations", ANNOTATIONS), T.StructField("anonymous_speaker", T.StringType()), T.StructField("end_sample", T.LongType()),
    T.StructField("index", T.LongType()), T.StructField("language", T.StringType()), T.StructField("start_sample", T.LongType()), T.StructField("text", T.StringType()),
])
#: A record is at most 1 MiB.
LONGEST = 1 << 20


def lines(segments: DataFrame) -> DataFrame:
    """(job_id, segment_index, line) of each segment."""
    note = F.struct(F.col("annotations.audio_event").alias("audio_event"), F.col("annotations.emotion").alias("emotion"))
    fields = {"annotations": note, "index": F.col("segment_index")} | {c: F.col(c) for c in ("anonymous_speaker", "end_sample", "language", "start_sample", "text")}
    return segments.select("job_id", "segment_index", canonical_json(**fields).alias("line"))


def write(segments: DataFrame, path: str) -> None:
    """One folder a job, its lines in order. The rows of a job are sorted within their task; none is gathered."""
    rows = lines(segments).repartition("job_id").sortWithinPartitions("job_id", "segment_index")
    rows.select("job_id", "line").write.partitionBy("job_id").mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``error``: NULL, or why a line is refused (too_long, no_json, unknown_key)."""
    rows = spark.read.option("wholetext", "false").text(path)
    keys = F.json_object_keys("value")
    rows = rows.withColumn("r", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))
    error = (
        F.when(F.octet_length("value") > LONGEST, "too_long").when(keys.isNull() | F.col("r").isNull(), "no_json")
        .when(F.array_sort(keys) != F.array(*[F.lit(f.name) for f in SCHEMA]), "unknown_key").when(F.col("r.index").isNull() | F.col("r.start_sample").isNull() | F.col("r.end_sample").isNull(), "no_json")
    )
    job = [F.col("job_id").cast("string").alias("job_id")] if "job_id" in rows.columns else [F.lit(None).cast("string").alias("job_id")]
    return rows.select(*job, F.col("r.index").alias("segment_index"), "r.start_sample", "r.end_sample", "r.text", "r.language", "r.annotations", "r.anonymous_speaker", error.alias("error"))
