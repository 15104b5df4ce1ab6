"""Transcript segments: summaries, joined text and result projections.

A segment table has job_id, segment_index, start_sample, end_sample, text, language, annotations (emotion, audio_event)
and anonymous_speaker; (job_id, segment_index) is its key once ``once`` has run. Blank texts count as records but appear in no
projection; indices of the others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import to_seconds
from ..functions.text import is_blank, letters, needs_space, strip
from .ordered import along

COLUMNS = ["start_sample", "end_sample", "text", "language", "annotations", "anonymous_speaker"]
#: The reference's bound of a recording (12 hours).
LONGEST = 691_200_000
#: Indices a chunk of ordered work spans.
SPAN = 4096


def once(records: DataFrame) -> DataFrame:
    """The first received of rows with equal (job_id, segment_index), ties by content; rows with a NULL key are dropped."""
    rows = records.where("job_id is not null and segment_index is not null")
    first = F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")), *[F.col(c) for c in COLUMNS])
    rows = rows.groupBy("job_id", "segment_index").agg(F.min_by(F.struct(*COLUMNS), first).alias("r"))
    return rows.select("job_id", "segment_index", "r.*")


def spoken() -> Column:
    return ~is_blank(F.col("text"))


def summary(segments: DataFrame) -> DataFrame:
    """One row a job: counts of records, of those with text and of those labelled, the last end, the language of the first with text (NULL
    if that one has none) and the labels of those with text in order of appearance."""
    order = F.when(spoken(), F.col("segment_index"))
    counts = segments.groupBy("job_id").agg(
        F.count("*").alias("records"), F.count_if(spoken()).alias("with_text"), F.count_if(spoken() & F.col("anonymous_speaker").isNotNull()).alias("labelled"),
        F.max("end_sample").alias("last_end"), F.min_by(F.struct("language"), order)["language"].alias("language"),
    )
    first = segments.where(spoken() & F.col("anonymous_speaker").isNotNull()).groupBy("job_id", "anonymous_speaker").agg(F.min("segment_index").alias("at"))
    labels = first.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "anonymous_speaker"))), lambda x: x["anonymous_speaker"]).alias("labels"))
    return counts.join(labels, "job_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def pieces(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """(job_id, segment_index, piece): what each segment with text adds to the joined text, with the space before it where the scripts need one."""
    rows = segments.where(spoken()).select("job_id", "segment_index", strip(F.col("text")).alias("t"))
    rows = along(rows, "job_id", ["segment_index"], span, prev={"p": F.substring("t", -1, 1)})
    return rows.select("job_id", "segment_index", F.when(F.col("p").isNotNull() & needs_space(F.col("p"), F.substring("t", 1, 1)), F.concat(F.lit(" "), F.col("t"))).otherwise(F.col("t")).alias("piece"))


def joined(segments: DataFrame) -> DataFrame:
    """(job_id, text): the whole text of each recording, however long; it is one value, so a task holds the text of its longest recording."""
    rows = pieces(segments)
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "piece"))), lambda x: x["piece"]), "").alias("text"))


def joined_parts(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """(job_id, part_no, text): the text of each recording in parts of ``span`` indices, which put together in order are ``joined``; no value grows with the recording. Parts without text are left out."""
    rows = pieces(segments, span).withColumn("part_no", F.floor(F.col("segment_index") / span).cast("long"))
    return rows.groupBy("job_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "piece"))), lambda x: x["piece"]), "").alias("text"))


def dense(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """Segments with a text other than '' and NULL, numbered anew from 0 in order (``dense_index``)."""
    rows = along(segments.where("text <> ''"), "job_id", ["segment_index"], span, total={"n": F.lit(1)})
    return rows.withColumn("dense_index", F.col("n") - 1).drop("n")


def verbose(segments: DataFrame) -> DataFrame:
    """(job_id, id, start, end, text) of the segments with text; times in seconds."""
    return segments.where(spoken()).select("job_id", F.col("segment_index").cast("string").alias("id"), to_seconds(F.col("start_sample")).alias("start"), to_seconds(F.col("end_sample")).alias("end"), strip(F.col("text")).alias("text"))


def diarized(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(job_id, id, start, end, speaker, text) of the labelled segments with text.

    Without ``names`` the speaker is the label. With it (job_id, label, name), the name, or ``Unknown`` and the label where there is none.
    """
    rows = segments.where(spoken() & F.col("anonymous_speaker").isNotNull()).withColumn("label", F.col("anonymous_speaker"))
    if names is None:
        rows = rows.withColumn("speaker", F.col("label"))
    else:
        rows = rows.join(names.select("job_id", "label", "name"), ["job_id", "label"], "left").withColumn("speaker", F.coalesce("name", F.concat(F.lit("Unknown "), F.col("label"))))
    return rows.select("job_id", F.col("segment_index").cast("string").alias("id"), to_seconds(F.col("start_sample")).alias("start"), to_seconds(F.col("end_sample")).alias("end"), "speaker", strip(F.col("text")).alias("text"))


def rich(segments: DataFrame) -> DataFrame:
    """(job_id, kind, label, start, end): a row for each emotion and audio event of the segments with text."""
    both = F.array(F.struct(F.lit("emotion").alias("kind"), F.col("annotations.emotion").alias("label")), F.struct(F.lit("audio_event").alias("kind"), F.col("annotations.audio_event").alias("label")))
    return segments.where(spoken()).select("job_id", F.inline(both), to_seconds(F.col("start_sample")).alias("start"), to_seconds(F.col("end_sample")).alias("end")).where("label is not null")


def label_use(segments: DataFrame) -> DataFrame:
    """(job_id, use): whether all, some or none of a job's segments with text are labelled."""
    rows = segments.where(spoken()).groupBy("job_id").agg(F.count("*").alias("n"), F.count("anonymous_speaker").alias("m"))
    return rows.select("job_id", F.when(F.col("m") == F.col("n"), "all").when(F.col("m") == 0, "none").otherwise("some").alias("use"))


def ordinals(segments: DataFrame) -> DataFrame:
    """(job_id, anonymous_speaker, ordinal): a job's labels numbered by first appearance. A job's labels are few; its segments are grouped first."""
    first = segments.where("anonymous_speaker is not null").groupBy("job_id", "anonymous_speaker").agg(F.min("segment_index").alias("at"))
    lists = first.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "anonymous_speaker"))).alias("l"))
    return lists.select("job_id", F.posexplode("l").alias("ordinal", "x")).select("job_id", F.col("x.anonymous_speaker").alias("anonymous_speaker"), F.col("ordinal").cast("long").alias("ordinal"))


def order_faults(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """(job_id, segment_index, fault): records that break their job's order: void (ends before or at its start), gap (its index does not follow on; the first is 0) or overlap (starts before the last end); the first that holds."""
    rows = along(segments.select("job_id", "segment_index", "start_sample", "end_sample"), "job_id", ["segment_index"], span, prev={"p": F.struct("segment_index", "end_sample")})
    fault = (
        F.when(~F.coalesce(F.col("end_sample") > F.col("start_sample"), F.lit(False)), "void").when(F.col("segment_index") != F.coalesce(F.col("p.segment_index") + 1, F.lit(0)), "gap")
        .when(F.col("start_sample") < F.col("p.end_sample"), "overlap")
    )
    return rows.select("job_id", "segment_index", fault.alias("fault")).where("fault is not null")


def mapping_errors(names: DataFrame) -> DataFrame:
    """(job_id, error): jobs whose mapping (job_id, label, id, name) is refused: repeated (a label twice), not_dense (the labels are not A, B, C up to their number) or two_names (an id has several)."""
    n = F.count("*")
    whole = names.groupBy("job_id").agg(n.alias("n"), F.count_distinct("label").alias("m"), F.array_sort(F.collect_set("label")).alias("labels"))
    # Labels in order of length and then letters are in order of their ordinals.
    want = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: letters(i))
    shape = whole.select("job_id", F.when(F.col("n") > F.col("m"), "repeated").when(F.size(F.array_except(want, "labels")) > 0, "not_dense").alias("error")).where("error is not null")
    twice = names.where("id is not null").groupBy("job_id", "id").agg(F.count_distinct("name").alias("k")).where("k > 1").select("job_id", F.lit("two_names").alias("error")).distinct()
    return shape.unionByName(twice)
