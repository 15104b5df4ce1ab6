"""Jobs, their leases and profiles: lookups, semi and anti joins, sums and row checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import elapsed_ms, reserved
from ..functions.text import matches

# Ids in Crockford's base 32, digests in hexadecimal.
PUBLIC_ID, DIGEST = "[0-9A-HJKMNP-TV-Z]{8}", "[0-9a-f]{64}"


def once(df: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One whole row a key: that of the greatest ``latest`` (NULL lowest), then the greatest by content; rows with a NULL key are dropped."""
    cols = df.columns
    rank = F.struct(*([F.col(latest).isNotNull(), F.col(latest)] if latest else []), F.xxhash64(*cols))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*cols), rank).alias("__r")).select("__r.*")


def with_leases(jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """Each job with its input lease's size and phase (NULL where the lease is missing) and the number and bytes of the leases it owns."""
    own = leases.where("owner_kind = 'job'").groupBy(F.col("owner_id").alias("__o")).agg(F.count("*").alias("leases"), F.sum("actual_bytes").alias("bytes"))
    lease = leases.select(F.col("id").alias("__l"), F.col("phase").alias("input_phase"), F.col("actual_bytes").alias("input_bytes"))
    rows = jobs.join(lease, F.col("input_lease_id") == F.col("__l"), "left").join(own, F.col("id") == F.col("__o"), "left")
    return rows.select("id", "status", "input_lease_id", "input_phase", "input_bytes", F.coalesce("leases", F.lit(0)).alias("leases"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def orphans(leases: DataFrame, jobs: DataFrame) -> DataFrame:
    """Leases of jobs that are not there."""
    return leases.where("owner_kind = 'job'").join(jobs.select(F.col("id").alias("owner_id")), "owner_id", "left_anti")


def guarded(jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """Jobs that own at least one sealed lease."""
    return jobs.join(leases.where("owner_kind = 'job' and phase = 'sealed'").select(F.col("owner_id").alias("id")), "id", "left_semi")


def usage(leases: DataFrame) -> DataFrame:
    """(lease_type, phase, n, reserved, actual, outstanding, quanta): sums, 0 where there is nothing to sum."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return leases.groupBy("lease_type", "phase").agg(
        F.count("*").alias("n"), zero(F.col("reserved_bytes")).alias("reserved"), zero(F.col("actual_bytes")).alias("actual"),
        zero(F.col("reserved_bytes") - F.col("actual_bytes")).alias("outstanding"), zero(reserved(F.col("actual_bytes"))).alias("quanta"),
    )


def waits(jobs: DataFrame) -> DataFrame:
    """(id, wait_ms, run_ms, audio_s, finished): times of a job; a finish before the start counts as the start."""
    end = F.when(F.col("finished_at").isNotNull(), F.greatest("finished_at", "started_at"))
    return jobs.select("id", elapsed_ms(F.col("created_at"), F.col("started_at")).alias("wait_ms"), elapsed_ms(F.col("started_at"), end).alias("run_ms"), (F.col("total_samples") / F.lit(16000.0)).alias("audio_s"), end.alias("finished"))


def differing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): rows that were added, removed or changed in any column, NULLs comparing equal."""
    cols = [c for c in before.columns if c != key]
    a, b = before.select(key, F.struct(*cols).alias("__a")), after.select(key, F.struct(*cols).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key, change.alias("change"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule that gives NULL for a row does not hold there. One pass over ``df``."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])))


def lease_rules() -> dict[str, Column]:
    c = F.col
    return {
        "lease_bytes": (c("actual_bytes") >= 0) & (c("actual_bytes") <= c("reserved_bytes")),
        "lease_sealed": (c("phase") != "sealed") | ((c("actual_bytes") == c("reserved_bytes")) & matches(c("content_sha256"), DIGEST)),
        "lease_phase": c("phase").isin("writing", "sealed"),
        "lease_owner": c("owner_kind").isin("sync", "job", "legacy"),
    }


def job_rules() -> dict[str, Column]:
    c = F.col
    return {
        "job_id": matches(c("id"), PUBLIC_ID),
        "job_progress": (c("processed_samples") >= 0) & (c("total_samples").isNull() | (c("processed_samples") <= c("total_samples"))),
        "job_times": c("started_at").isNull() | (c("started_at") >= c("created_at")),
        "job_recoveries": c("crash_recoveries").between(0, 1),
    }


# Of each state the columns that hold something and those that hold nothing.
RECEIVING_SET = ["input_lease_id"]
RECEIVING_EMPTY = [
    "status", "canonical_options_json", "selected_speaker_snapshot", "snapshot_sha256", "input_size_bytes", "effective_max_audio_samples", "effective_direct_max_audio_samples", "total_samples", "request_fingerprint",
    "processor_fingerprint", "attempt_token", "owner_generation", "result_lease_id", "error_code", "started_at", "finished_at",
]
DESCRIBED = ["canonical_options_json", "input_size_bytes", "effective_max_audio_samples", "effective_direct_max_audio_samples", "request_fingerprint", "processor_fingerprint"]
STATES = {
    "queued": (["input_lease_id"], ["attempt_token", "owner_generation", "result_lease_id", "error_code", "started_at", "finished_at"]),
    "running": (["input_lease_id", "attempt_token", "owner_generation", "started_at"], ["result_lease_id", "error_code", "finished_at"]),
    "succeeded": (["started_at", "finished_at", "total_samples", "result_lease_id"], ["attempt_token", "owner_generation", "error_code"]),
    "failed": (["started_at", "finished_at", "error_code"], ["attempt_token", "owner_generation", "result_lease_id"]),
    "cancelled": (["finished_at"], ["attempt_token", "owner_generation", "result_lease_id", "error_code"]),
}
DONE = ["succeeded", "failed", "cancelled"]


def state_rules() -> dict[str, Column]:
    """Rules on the shape of a job's row: what each state needs and excludes, and how its numbers and times lie to each other. A rule on one state holds for rows of others."""
    c = F.col
    every = lambda *conditions: functools.reduce(lambda a, b: a & b, conditions)
    shape = lambda held, empty: every(*[c(x).isNotNull() for x in held], *[c(x).isNull() for x in empty])
    given = lambda case, rule: ~F.coalesce(case, F.lit(False)) | rule
    unless_null = lambda x, rule: x.isNull() | rule
    zero, no = lambda *names: every(*[c(x) == 0 for x in names]), lambda *names: every(*[~c(x) for x in names])
    status = lambda x: c("status") == x
    receiving = (c("phase") == "receiving") | ((c("phase") == "deleting") & c("status").isNull())
    most, direct = c("effective_max_audio_samples"), c("effective_direct_max_audio_samples")
    rules = {
        "known_state": c("phase").isin("receiving", "visible", "deleting") & unless_null(c("status"), c("status").isin(list(STATES))) & given(c("phase") == "visible", c("status").isNotNull()),
        "deleted_when_done": given((c("phase") == "deleting") & c("status").isNotNull(), c("status").isin(DONE)),
        "counts": every(*[unless_null(c(x), c(x) >= 0) for x in ("input_size_bytes", "total_samples")], *[c(x) >= 0 for x in ("processed_samples", "attempt_no", "crash_recoveries")]) & (c("crash_recoveries") <= c("attempt_no")),
        "digests": every(*[unless_null(c(x), matches(c(x), DIGEST)) for x in ("snapshot_sha256", "request_fingerprint", "processor_fingerprint")]),
        "no_empty_texts": every(*[unless_null(c(x), c(x) != "") for x in ("input_lease_id", "canonical_options_json", "attempt_token", "owner_generation", "result_lease_id", "error_code")]),
        "caps": unless_null(most, most.between(1, 691_200_000)) & unless_null(direct, most.isNotNull() & direct.between(F.lit(1), F.least(most, F.lit(480_000)))),
        "within_caps": unless_null(most, (c("processed_samples") <= most) & unless_null(c("total_samples"), c("total_samples") <= most)),
        "times_in_order": unless_null(c("started_at"), c("started_at") >= c("created_at")) & unless_null(c("finished_at"), c("finished_at") >= F.coalesce("started_at", "created_at")),
        "receiving": given(receiving, shape(RECEIVING_SET, RECEIVING_EMPTY) & zero("processed_samples", "attempt_no", "crash_recoveries") & no("cancel_requested", "input_cleanup_pending")),
        "described": given(c("status").isNotNull(), shape(DESCRIBED, [])),
    }
    more = {
        "queued": zero("processed_samples") & no("cancel_requested", "input_cleanup_pending") & ((c("attempt_no") > 0) | c("total_samples").isNull()), "running": (c("attempt_no") >= 1) & no("input_cleanup_pending"),
        "succeeded": (c("attempt_no") >= 1) & (c("processed_samples") == c("total_samples")) & no("cancel_requested"), "failed": (c("attempt_no") >= 1) & no("cancel_requested"),
        "cancelled": F.when(c("attempt_no") == 0, c("started_at").isNull() & no("cancel_requested")).otherwise(c("started_at").isNotNull() & c("cancel_requested")),
    }
    for name, (held, empty) in STATES.items():
        rules[name] = given(status(name), shape(held, empty) & more[name])
    rules["cleanup_told"] = given(c("status").isin(DONE), c("input_cleanup_pending") == c("input_lease_id").isNotNull())
    return rules


def segment_rules() -> dict[str, Column]:
    c = F.col
    return {
        "segment_span": (c("start_sample") >= 0) & (c("end_sample") > c("start_sample")),
        "segment_index": c("segment_index") >= 0,
        "segment_longest": c("end_sample") <= 691_200_000,
    }
