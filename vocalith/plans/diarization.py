"""From speech to named speakers: islands, windows, clusters, cells, regions and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import letters
from ..operators import intervals, spectral
from ..operators.intervals import LONGEST
from ..operators.store import settle


def regions(speech: DataFrame, windows: DataFrame, keep: float = 1.0, low: float = 2.0, gap: float = 0.5) -> DataFrame:
    """(job_id, label, start, end): speaker regions of each recording, however long.

    ``speech`` has job_id, start, end; ``windows`` has job_id, start_sample, end_sample and embedding. Windows are clustered, each takes the cell
    nearest its centre, cells are cut with the islands of speech, touching cells of one speaker within an island join, and what
    is longer than 480,000 samples is cut.
    """
    # What several steps read is written once.
    islands = settle(intervals.islands(speech))
    ordinals = settle(spectral.by_recording(windows, longest=None, keep=keep, low=low, gap=gap).where("error is null").drop("error"))
    total = islands.groupBy("job_id").agg(F.max("end").alias("total"))
    cells = intervals.cells(ordinals.join(total, "job_id"), "total")
    cells = cells.select("job_id", "ordinal", F.col("cell_start").alias("start"), F.col("cell_end").alias("end"))
    parts = settle(intervals.overlaps(cells, islands).select("job_id", F.col("l.ordinal").alias("ordinal"), F.col("r.start").alias("island"), "start", "end"))
    runs = intervals.merged(parts, "ordinal", within="island")
    return intervals.split(runs.select("job_id", "ordinal", "start", "end"), LONGEST).select("job_id", letters(F.col("ordinal")).alias("label"), "start", "end")
