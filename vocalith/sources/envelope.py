"""Results as a file of two parts: one line of JSON that describes the body, and the body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import canonical_json

MANIFEST = "content_type string, sha256 string, size long, version int"


def sealed(results: DataFrame, content_type: str, body: str = "body") -> DataFrame:
    """``results`` with ``envelope``: the manifest of the body's type, size and digest, a line feed and the body."""
    b = F.col(body)
    line = canonical_json(content_type=F.lit(content_type), sha256=F.sha2(b, 256), size=F.octet_length(b).cast("long"), version=F.lit(1))
    return results.withColumn("envelope", F.concat(line, F.lit("\n"), b))


def opened(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (BINARY content) with content_type, body and ``error``: no_manifest, wrong_size, wrong_digest or NULL."""
    text = F.decode(F.col(content), "UTF-8")
    cut = F.instr(text, "\n")
    head, body = F.substring(text, F.lit(1), cut - 1), F.substring(text, cut + 1, F.length(text))
    m = F.from_json(head, MANIFEST, {"mode": "PERMISSIVE"})
    rows = files.withColumn("__m", F.when(cut > 1, m)).withColumn("body", F.when(cut > 0, body))
    error = (
        F.when(F.col("__m").isNull() | F.col("__m.sha256").isNull() | F.col("__m.size").isNull(), "no_manifest")
        .when(F.octet_length("body") != F.col("__m.size"), "wrong_size").when(F.sha2("body", 256) != F.col("__m.sha256"), "wrong_digest")
    )
    return rows.withColumn("content_type", F.col("__m.content_type")).withColumn("error", error).drop("__m")


def read(spark: SparkSession, path: str) -> DataFrame:
    return opened(spark.read.format("binaryFile").load(path).select("path", "content"))
