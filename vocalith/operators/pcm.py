"""Samples of intervals: blocks into windows and regions, with gaps as zeros, and checks of a stream of blocks.

A block has job_id, start and pcm ARRAY<SMALLINT>; its end is start + size(pcm).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .intervals import BLOCK, overlaps
from .ordered import SPAN, along

LONGEST = 691_200_000


def _filled(pieces: Column, start: Column, end: Column) -> Column:
    """Samples from ``start`` to ``end`` out of ordered pieces (s, pcm) that do not overlap, zeros between them."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("smallint"), n.cast("int"))
    begin = F.struct(start.alias("at"), F.array().cast("array<smallint>").alias("x"))
    whole = F.aggregate(pieces, begin, lambda a, p: F.struct((p["s"] + F.size(p["pcm"])).alias("at"), F.concat(a["x"], zeros(p["s"] - a["at"]), p["pcm"]).alias("x")))
    return F.concat(whole["x"], zeros(end - whole["at"]))


def cut_out(spans: DataFrame, blocks: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, start, end, pcm, covered): the samples of each span out of the blocks, zeros where there are none; covered counts the others.

    Spans are windows or regions and so bounded in length; what is gathered is one span's samples. Spans without any block have zeros only. Of
    blocks with one start the longest counts.
    """
    spans = spans.where("end > start").select(key, "start", "end").distinct()
    one = blocks.groupBy(key, "start").agg(F.max_by("pcm", F.size("pcm")).alias("pcm")).withColumn("end", F.col("start") + F.size("pcm"))
    found = overlaps(spans, one, key)
    part = F.slice("r.pcm", (F.col("start") - F.col("r.start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    found = found.select(F.col(key), F.col("l.start").alias("__s"), F.col("l.end").alias("__e"), F.struct(F.col("start").alias("s"), part.alias("pcm")).alias("piece"))
    lists = found.groupBy(key, F.col("__s").alias("start"), F.col("__e").alias("end")).agg(F.array_sort(F.collect_list("piece")).alias("__p"))
    rows = spans.join(lists, [key, "start", "end"], "left").withColumn("__p", F.coalesce("__p", F.array().cast("array<struct<s:bigint,pcm:array<smallint>>>")))
    covered = F.aggregate("__p", F.lit(0).cast("long"), lambda n, p: n + F.size(p["pcm"]))
    return rows.select(key, "start", "end", _filled(F.col("__p"), F.col("start"), F.col("end")).alias("pcm"), covered.alias("covered"))


def cut(blocks: Iterable[tuple[int, np.ndarray]], start: int, end: int) -> tuple[np.ndarray, int]:
    """(pcm, covered) of one span as ``cut_out`` has them, out of the blocks (start, samples) of its recording that a task holds already. Blocks must not overlap."""
    out, covered = np.zeros(end - start, np.int16), 0
    for at, x in blocks:
        low, high = max(start, at), min(end, at + len(x))
        if low < high:
            out[low - start : high - start] = x[low - at : high - at]
            covered += high - low
    return out, covered


def faults(blocks: DataFrame, key: str = "job_id", size: int = BLOCK, longest: int = LONGEST, span: int = SPAN) -> DataFrame:
    """(key, start, fault): blocks that break the order of a recording: empty, too_long, gap (not where the last ended), short (before the last one), beyond (past ``longest``)."""
    rows = blocks.select(key, "start", F.size("pcm").cast("long").alias("__n"))
    rows = along(rows, key, ["start"], span, prev={"__p": F.col("start") + F.col("__n")}, next={"__x": F.col("start")})
    fault = (
        F.when(F.col("__n") < 1, "empty").when(F.col("__n") > size, "too_long").when(F.col("start") != F.coalesce("__p", F.lit(0)), "gap")
        .when((F.col("__n") < size) & F.col("__x").isNotNull(), "short").when(F.col("start") + F.col("__n") > longest, "beyond")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select(key, "start", "fault")


def progress(ticks: DataFrame, key: str = "job_id", span: int = SPAN) -> DataFrame:
    """(key, processed, total, complete, fell): of ticks (key, seq, processed, total NULL until known) the furthest point, the total, whether both are equal, and how often a tick
    fell behind an earlier one."""
    rows = along(ticks.select(key, "seq", "processed", "total"), key, ["seq"], span, top_before={"__m": F.col("processed")})
    out = rows.groupBy(key).agg(F.max("processed").alias("processed"), F.max("total").alias("total"), F.count_if(F.col("processed") < F.col("__m")).alias("fell"))
    return out.select(key, "processed", "total", F.coalesce(F.col("processed") == F.col("total"), F.lit(False)).alias("complete"), "fell")
