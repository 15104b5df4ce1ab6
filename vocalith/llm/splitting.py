"""Items longer than a limit into overlapping pieces, cut at natural boundaries where one is in reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .runs import CHUNK_SAMPLES


def cut(ends: np.ndarray, size: int, start: int, limit: int, overlap: int, final: bool) -> tuple[list[tuple[int, int]], int]:
    """Pieces from ``start`` on over sorted boundaries ``ends``, and where the next piece starts.

    Without ``final`` more boundaries may follow, so it stops at the first piece they could change.
    """
    out = []
    while size - start > limit:
        if not final and (not len(ends) or ends[-1] <= start + limit):
            return out, start
        i = np.searchsorted(ends, start + limit, "right") - 1
        stop = int(ends[i]) if i >= 0 and ends[i] > start + overlap else start + limit
        out.append((start, stop))
        start = stop - overlap
    if final:
        out.append((start, size))
    return out, start


def quiet_ends(records: DataFrame, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """(job_id, b): the end_samples of a job's records inside none of its records, each once.

    A sweep over starts and ends: b is quiet if no record that starts before it ends after it. The running maximum is
    kept within (job, chunk of the clock) and carried over chunks by one row each.
    """
    spans = records.select("job_id", "start_sample", "end_sample").where("job_id is not null and start_sample is not null and end_sample is not null").distinct()
    marks = F.array(
        F.struct(F.col("end_sample").alias("at"), F.lit(0).alias("opens"), F.lit(None).cast("long").alias("e")),
        F.struct(F.col("start_sample").alias("at"), F.lit(1).alias("opens"), F.col("end_sample").alias("e")),
    )
    swept = spans.select("job_id", F.inline(marks)).withColumn("c", F.floor(F.col("at") / F.lit(chunk)))
    own = Window.partitionBy("job_id", "c").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("job_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    carried = swept.groupBy("job_id", "c").agg(F.max("e").alias("top")).select("job_id", "c", F.max("top").over(past).alias("before"))
    swept = swept.withColumn("top", F.max("e").over(own)).join(carried, ["job_id", "c"])
    return swept.where((F.col("opens") == 0) & (F.coalesce(F.greatest("top", "before"), F.col("at")) <= F.col("at"))).select("job_id", F.col("at").alias("b")).distinct()


def split_long_jobs(jobs: DataFrame, records: DataFrame, limit: int = 4_800_000, overlap: int = 80_000, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Pieces (job_id, piece_no, start_sample, end_sample, natural) of each job whose largest total_samples is above ``limit``.

    A job's boundaries reach one task in order and are cut as they stream by, so that only those within one piece are held.
    Jobs of unknown size, and rows with a null id, have no pieces. ``overlap`` must be less than ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    long = jobs.where("id is not null").groupBy(F.col("id").alias("job_id")).agg(F.max("total_samples").cast("long").alias("size")).where(F.col("size") > limit)
    own = records.select("job_id", "start_sample", "end_sample").join(long.select("job_id"), "job_id", "left_semi")
    ends = quiet_ends(own, chunk)
    # The bounds stand in the join's condition, so that a job all of whose boundaries lie outside keeps a row. No union here: one of two branches that
    # are both hashed by job would take the place of the exchange, and their partitions may then be coalesced apart.
    inside = (long["job_id"] == ends["job_id"]) & (ends["b"] > 0) & (ends["b"] < long["size"])
    feed = long.join(ends, inside, "left").select(long["job_id"], "size", "b").repartition("job_id").sortWithinPartitions("job_id", "b")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, at, no, kept = None, 0, 0, 0, np.empty(0, np.int64)

        def pieces(final: bool) -> list[tuple]:
            nonlocal at, no, kept
            got, at = cut(kept, size, at, limit, overlap, final)
            ends = set(kept.tolist()) if got else ()
            rows = [(key, no + i, s, e, e in ends or e == size) for i, (s, e) in enumerate(got)]
            no += len(got)
            kept = kept[kept > at + overlap]
            return rows

        for batch in batches:
            rows: list[tuple] = []
            for name, part in batch.groupby("job_id", sort=False):
                if name != key:
                    if key is not None:
                        rows += pieces(True)
                    key, size, at, no, kept = name, int(part["size"].iloc[0]), 0, 0, np.empty(0, np.int64)
                kept = np.concatenate([kept, part["b"].dropna().to_numpy(np.int64)])
                rows += pieces(False)
            yield pd.DataFrame(rows, columns=columns)
        if key is not None:
            yield pd.DataFrame(pieces(True), columns=columns)

    columns = ["job_id", "piece_no", "start_sample", "end_sample", "natural"]
    return feed.mapInPandas(stream, "job_id string, piece_no long, start_sample long, end_sample long, natural boolean")
