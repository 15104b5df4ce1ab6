"""Checks of options, sizes and batches: each gives a code, NULL where nothing is wrong; of several the first in order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matches
from .intervals import LONGEST, coverage, islands, overlaps, valid
from .ledger import PUBLIC_ID

# What options may hold, in the order in which parts are written.
MODELS, LANGUAGES = ["sensevoice", "sensevoice-diarize"], ["auto", "zh", "en", "yue", "ja", "ko"]
FORMATS, INCLUDES = ["json", "text", "verbose_json", "diarized_json"], ["funasr.emotion", "funasr.audio_events"]
SPEAKERS, DIARIZED_SECONDS, MOST_SAMPLES, RATE = 32, 1_800, 691_200_000, 16_000
# Containers of audio that a probe may name.
CONTAINERS = ["3g2", "3gp", "flac", "m4a", "matroska", "mj2", "mov", "mp3", "mp4", "mpeg", "ogg", "wav", "webm"]


def option_error(model: Column, language: Column, fmt: Column, chunking: Column, include: Column, known: Column) -> Column:
    """The first rule that options break, of eleven codes; ``include`` and ``known`` are arrays, NULL as empty, and an empty ``fmt`` is the default one."""
    no = F.array().cast("array<string>")
    include, known = F.coalesce(include, no), F.coalesce(known, no)
    speakers = F.coalesce(model == "sensevoice-diarize", F.lit(False))
    fmt = F.when(~speakers & (fmt.isNull() | (fmt == "")), "json").otherwise(F.coalesce(fmt, F.lit("")))
    within = lambda c, xs: F.coalesce(c.isin(xs), F.lit(False))
    return (
        F.when(~within(model, MODELS), "invalid_model").when(~within(language, LANGUAGES), "invalid_language").when(chunking.isNotNull() & (chunking != "auto"), "invalid_chunking_strategy")
        .when(speakers & chunking.isNull(), "diarization_requires_vad").when(speakers & (fmt != "diarized_json"), "diarization_requires_format")
        .when(~speakers & (fmt == "diarized_json"), "diarized_format_requires_model").when(~fmt.isin(FORMATS), "invalid_response_format")
        .when(F.size(F.array_except(include, F.array(*map(F.lit, INCLUDES)))) > 0, "invalid_include").when((fmt == "text") & (F.size(include) > 0), "incompatible_response_format")
        .when((F.size(F.array_distinct(known)) < F.size(known)) | (F.size(known) > SPEAKERS) | F.exists(known, lambda x: ~F.coalesce(matches(x, PUBLIC_ID), F.lit(False))), "invalid_known_speaker_ids")
        .when((F.size(known) > 0) & ~speakers, "known_speakers_require_diarization")
    )


def ordered(requested: Column, order: list[str]) -> Column:
    """The members of ``order`` that are requested, in its order, each once."""
    return F.array_intersect(F.array(*map(F.lit, order)), F.coalesce(requested, F.array().cast("array<string>")))


def length_error(seconds: Column, speakers: Column, chunked: Column, waits: Column, most: Column, direct: Column, sync: Column) -> Column:
    """Why audio of so many seconds is not taken: by the bounds of recordings with speakers, of any, of those that are not chunked, and of those somebody waits for."""
    return (
        F.when(speakers & (seconds > DIARIZED_SECONDS), "diarization_too_long").when(seconds > most, "audio_too_long")
        .when(~chunked & (seconds > direct), "long_audio_requires_vad").when(waits & (seconds > sync), "async_required")
    )


def direct_cap(direct_seconds: Column, most_seconds: Column) -> Column:
    """The samples taken without chunking: the least of both bounds and the longest segment."""
    return F.least(direct_seconds * RATE, most_seconds * RATE, F.lit(LONGEST)).cast("long")


def cap_error(most: Column, direct: Column) -> Column:
    """Whether the bounds of a job, in samples, lie within their ranges."""
    fits = lambda x, top: F.coalesce((x >= 1) & (x <= top), F.lit(False))
    return F.when(~fits(most, F.lit(MOST_SAMPLES)), "bad_most").when(~fits(direct, F.least(most, F.lit(LONGEST))), "bad_direct")


def compatible(model: Column, revision: Column, dim: Column, fingerprint: Column, policy: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a profile was made by the embedding model of a policy: all four are equal; NULL equals nothing."""
    return F.coalesce((model == policy[0]) & (revision == policy[1]) & (dim == policy[2]) & (fingerprint == policy[3]), F.lit(False))


def whole_batches(rows: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """``rows`` of the batches (keys) all of whose rows are good; one bad row, or one of which that is unknown, rejects its batch.

    The batches' verdicts are combined before they move, and are joined back.
    """
    kept = rows.groupBy(*keys).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("__ok")).where("__ok").select(*keys)
    return rows.join(kept, keys, "left_semi")


def zipped(left: Column, right: Column) -> Column:
    """Pairs of two arrays of one length; NULL where the lengths differ or one is NULL, so that nothing is padded."""
    return F.when(F.size(left) == F.size(right), F.arrays_zip(left.alias("a"), right.alias("b")))


def lookup(table: DataFrame, wanted: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(found, missing): the whole rows of the wanted keys, each once, and the keys that have none; NULL keys are neither."""
    ids = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return table.join(ids, key, "left_semi"), ids.join(table.select(key), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """(keys, n): groups of more than ``most`` rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)


def queue_error(jobs: DataFrame, most: int = 16) -> DataFrame:
    """(queued, error): one row, how many jobs wait and whether one more is refused."""
    n = jobs.where("phase = 'visible' and status = 'queued'").agg(F.count("*").alias("queued"))
    return n.select("queued", F.when(F.col("queued") >= most, "too_many_queued_jobs").alias("error"))


def sweep(jobs: DataFrame, cutoff: Column, batch: int = 32) -> DataFrame:
    """(id, phase, finished_at): the next jobs to clear away, those being deleted first, then by end and id, of those that finished by ``cutoff``; the number is the batch."""
    done = jobs.where("status in ('succeeded', 'failed', 'cancelled')").where((F.col("phase") == "deleting") | ((F.col("phase") == "visible") & (F.col("finished_at") <= cutoff)))
    first = F.when(F.col("phase") == "deleting", 0).otherwise(1)
    return done.select("id", "phase", "finished_at").distinct().orderBy(first, "finished_at", "id").limit(batch)


def tiling_errors(speech: DataFrame, segments: DataFrame) -> DataFrame:
    """(job_id, kind, start, end, samples): where segments do not tile the islands of speech exactly.

    uncovered: an island of which so many samples lie in no segment; twice: one of which so many samples lie in several; outside: a segment that meets no island. Void intervals count for nothing.
    """
    isl = islands(speech)
    seg = valid(segments).select("job_id", "start", "end").distinct()
    covered = coverage(isl, seg)
    twice = overlaps(isl, seg).groupBy("job_id", F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(F.sum(F.col("end") - F.col("start")).alias("summed"))
    rows = covered.join(twice, ["job_id", "start", "end"], "left")
    found = F.array(
        F.struct(F.lit("uncovered").alias("kind"), (F.col("end") - F.col("start") - F.col("covered")).alias("samples")),
        F.struct(F.lit("twice").alias("kind"), (F.coalesce("summed", F.lit(0)) - F.col("covered")).alias("samples")),
    )
    inside = rows.select("job_id", "start", "end", F.inline(found)).where("samples > 0")
    outside = coverage(seg, isl).where("covered = 0").select("job_id", "start", "end", F.lit("outside").alias("kind"), F.expr("`end` - `start`").alias("samples"))
    return inside.unionByName(outside).select("job_id", "kind", "start", "end", "samples")


def generation_of(rows: DataFrame, generation: str, marker: DataFrame) -> DataFrame:
    """``rows`` with ``current``: whether their generation is that of ``marker`` (one row with the column ``generation``). What is sent to every task is that one row."""
    one = marker.agg(F.max("generation").alias("__g"), F.lit(1).alias("__one"))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one", "left").withColumn("current", F.coalesce(F.col(generation) == F.col("__g"), F.lit(False))).drop("__one", "__g")


def prefers_async(header: Column) -> Column:
    """Whether a header's list of preferences holds ``respond-async``, whatever its case and spaces."""
    return F.coalesce(F.exists(F.split(header, ","), lambda x: F.lower(F.trim(x)) == "respond-async"), F.lit(False))


def container_error(names: Column) -> Column:
    """Whether all names a probe gives a container (parted by commas) are known ones."""
    return F.when(names.isNull() | (F.size(F.array_except(F.split(names, ","), F.array(*map(F.lit, CONTAINERS)))) > 0), "invalid_audio")
