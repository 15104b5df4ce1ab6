"""Jobs, speakers and models as JSON resources, members in the order of the wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import instant
from ..functions.text import quoted, seconds_text


def _object(*members: tuple[str, Column]) -> Column:
    """A JSON object of members whose values are JSON already; a NULL one is null."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(members):
        parts += [F.lit(f'{"," if i else "{"}"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def jobs(rows: DataFrame) -> DataFrame:
    """(id, status, resource): progress of what waits or runs, the error of what failed, the end of what was cancelled; NULL for what succeeded, whose resource is its result."""
    c = F.col
    crashed = F.coalesce(c("error_code") == "worker_crashed", F.lit(False))
    progress = _object(("processed_audio_secs", seconds_text(c("processed_samples"))), ("total_audio_secs", seconds_text(c("total_samples"))))
    # The messages of failures.
    message = F.when(crashed, "The transcription worker crashed").otherwise("Internal server error")
    error = _object(("message", quoted(message)), ("type", F.lit('"server_error"')), ("param", F.lit("null")), ("code", F.when(crashed, '"worker_crashed"').otherwise('"internal_error"')))
    head, end = [("id", quoted(c("id"))), ("status", quoted(c("status")))], ("finished_at", quoted(instant(c("finished_at"))))
    resource = (
        F.when(c("status").isin("queued", "running"), _object(*head, ("progress", progress))).when(c("status") == "failed", _object(*head, ("error", error), end))
        .when(c("status") == "cancelled", _object(*head, end))
    )
    return rows.select("id", "status", resource.alias("resource"))


def speakers(profiles: DataFrame, model: str) -> DataFrame:
    """(id, resource): profiles without their embedding; ``model`` is the public name of the embedding model."""
    c = F.col
    number = lambda name: c(name).cast("string")
    inner = _object(("id", quoted(F.lit(model))), ("revision", quoted(c("embedding_model_revision"))), ("dimension", number("embedding_dimension")), ("policy_fingerprint", quoted(c("embedding_policy_fingerprint"))))
    whole = _object(
        ("id", quoted(c("id"))), ("object", F.lit('"speaker"')), ("name", quoted(c("name"))), ("description", quoted(c("description"))), ("sample_count", number("sample_count")),
        ("embedding_model", inner), ("created_at", quoted(instant(c("created_at")))), ("updated_at", quoted(instant(c("updated_at")))),
    )
    return profiles.select("id", whole.alias("resource"))


def models(names: DataFrame, created: int, owner: str) -> DataFrame:
    """(id, resource) of each model."""
    return names.select("id", _object(("id", quoted(F.col("id"))), ("object", F.lit('"model"')), ("created", F.lit(str(created))), ("owned_by", quoted(F.lit(owner)))).alias("resource"))
