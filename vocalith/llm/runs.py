"""Repeated consecutive events: each run of events with one label becomes one row.

A run is found from boundary rows alone. The events of a key are cut into chunks of the clock, so that a
key that holds a third of all rows is still spread over many tasks: windows run within (key, chunk), and
what crosses a chunk's edge (last label, latest end, number of rows) is carried by one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.store import settle
from . import marks

#: Samples a chunk of the clock spans: 1,000 seconds at 16 kHz, in which there are at most some thousands of regions or records.
CHUNK_SAMPLES = 16_000_000


def collapse_runs(
    rows: DataFrame, key: Column, label: Column, start: Column, end: Column, gap: int, tie: Column | None = None, chunk: int = CHUNK_SAMPLES
) -> DataFrame:
    """Runs (key, label, start, end, n_events, duration, first) of consecutive events, ordered by (start, end, tie); first is the tie of the first event.

    An event continues the run if it has the label of the one before and starts at most ``gap`` after the run's
    latest end so far. Rows with a null key, start or end, or end <= start, are void; a null label is a label of
    its own, whose runs come out with a null label. Ties beyond ``tie`` are ordered by label. No row gives no run.
    Starts being ordered, an end from before the run cannot reach past it, so the latest end over the whole block of equal
    labels serves for the run.
    """
    base = rows.select(
        key.alias("k"), F.coalesce(label, F.lit("")).alias("l"), start.alias("s"), end.alias("e"),
        (tie if tie is not None else F.lit(0)).cast("long").alias("t"), F.floor(start / F.lit(chunk)).cast("long").alias("c"),
    ).where("k is not null and s is not null and e > s")
    inside = Window.partitionBy("k", "c").orderBy("s", "e", "t", "l")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        base.withColumn("prev", F.lag("l").over(inside))
        .withColumn("p", F.row_number().over(inside))
        .withColumn("first_l", F.first("l").over(upto))
        .withColumn("is_last", F.lead("s").over(inside).isNull())
        .withColumn("b", F.sum((F.col("prev").isNull() | (F.col("prev") != F.col("l"))).cast("long")).over(upto))
        .withColumn("m", F.max(F.struct("b", "e")).over(before))
        .withColumn("own", F.when(F.col("m.b") == F.col("b"), F.col("m.e")))
        .withColumn("edge", F.col("own").isNull() | (F.col("s") > F.col("own") + gap))
    )
    # Only boundary rows go on, and the last row of each chunk. What came before the chunk can undo a boundary, not make one.
    kept = settle(
        seen.where("edge or is_last").select(
            "k", "c", "l", "s", "t", "p", "b", "edge", "own", F.col("m.b").alias("mb"), F.col("m.e").alias("me"), "first_l", F.when(F.col("is_last"), F.greatest("own", "e")).alias("tail")
        )
    )

    # One row a chunk, and what reaches it from the chunks before.
    along = Window.partitionBy("k").orderBy("c")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        kept.where("tail is not null").select("k", "c", "first_l", F.col("l").alias("last_l"), F.col("b").alias("blocks"), "tail", F.col("p").alias("n"))
        .withColumn("in_l", F.lag("last_l").over(along))
        .withColumn("group", F.sum(((F.col("blocks") > 1) | ~F.col("in_l").eqNullSafe(F.col("first_l"))).cast("long")).over(along))
        .withColumn("in_e", F.max(F.struct("group", "tail")).over(past)["tail"])
        .withColumn("in_n", F.coalesce(F.sum("n").over(past), F.lit(0)))
        .withColumn("out_e", F.max(F.struct("group", "tail")).over(along)["tail"])
    )
    # What ends the key's last run goes along with each chunk, so that it needs no join of its own.
    end_of_key = F.max_by(F.struct((F.col("in_n") + F.col("n") + 1).alias("g"), F.col("out_e").alias("prior")), "c").over(Window.partitionBy("k"))
    carried = chunks.withColumn("last", end_of_key).select("k", "c", "in_l", "in_e", "in_n", "last")

    placed = kept.where("edge").join(carried, ["k", "c"])
    inherited = F.when((F.col("b") == 1) & (F.col("in_l") == F.col("l")), F.col("in_e"))
    reach = F.greatest("own", inherited)
    joined = F.col("in_l") == F.col("first_l")
    prior = F.when(F.col("mb").isNull(), F.col("in_e")).otherwise(F.greatest("me", F.when((F.col("mb") == 1) & joined, F.col("in_e"))))
    edges = placed.where(reach.isNull() | (F.col("s") > reach + gap)).select("k", "c", "l", "s", "t", (F.col("in_n") + F.col("p")).alias("g"), prior.alias("prior"), "last")

    # Boundary rows only from here on: the next boundary gives the count (positions) and the end (its prior end).
    step = Window.partitionBy("k", "c").orderBy("g")
    edges = edges.withColumn("next", F.lead(F.struct("g", "prior")).over(step))
    heads = edges.groupBy("k", "c").agg(F.min(F.struct("g", "prior")).alias("head"), F.first("last").alias("last"))
    heads = heads.select("k", "c", F.coalesce(F.lead("head").over(along), "last").alias("over"))
    runs = edges.join(heads, ["k", "c"]).withColumn("next", F.coalesce("next", "over"))
    return runs.select(
        F.col("k").alias("key"), F.when(F.col("l") != "", F.col("l")).alias("label"), F.col("s").alias("start"), F.col("next.prior").alias("end"),
        (F.col("next.g") - F.col("g")).alias("n_events"), (F.col("next.prior") - F.col("s")).alias("duration"), F.col("t").alias("first"),
    )


def region_runs(regions: DataFrame, gap: int = 1600, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Runs of ``speaker_regions``: (job_id, speaker, start_sample, end_sample, n_regions, duration), single regions included.

    Rows of equal (job_id, start_sample, end_sample) are one region, named by the earliest received row that names
    somebody. Regions that name nobody end a run and are in none. Other columns are ignored.
    """
    named = regions.select("job_id", "start_sample", "end_sample", "received_at", marks.label_letters(F.col("anonymous_speaker")).alias("speaker"))
    one = (
        named.where("end_sample > start_sample and job_id is not null")
        .groupBy("job_id", "start_sample", "end_sample")
        .agg(F.min(F.when(F.col("speaker").isNotNull(), F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")), "speaker")))["speaker"].alias("speaker"))
    )
    runs = collapse_runs(one, F.col("job_id"), F.col("speaker"), F.col("start_sample"), F.col("end_sample"), gap, chunk=chunk)
    return runs.where("label is not null").select(
        F.col("key").alias("job_id"), F.col("label").alias("speaker"), F.col("start").alias("start_sample"),
        F.col("end").alias("end_sample"), F.col("n_events").alias("n_regions"), "duration",
    )
