"""Markers of begin and end, and blocks of samples, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.clock import RATE
from .speech import ProtocolError, SpeechCutter

SPANS = "key string, start long, stop long, outcome string"
_STATE = "open_ms long, last_ms long"


def spans(markers: DataFrame, key: str, order: str, begin: str, end: str) -> DataFrame:
    """Spans (key, start, stop in samples, outcome) of a stream of markers, by the protocol of ``operators.markers``.

    A key's markers must come in order over the batches; within one they are sorted. What breaks the protocol comes out as an
    outcome of its own, never silently. The state of a key is two numbers.
    """

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for b, e in zip(rows[begin], rows[end]):
            b, e = (None if pd.isna(b) else int(b)), (None if pd.isna(e) else int(e))
            was, opened = opened, None
            if (b is None and e is None) or (b or 0) < 0 or (e or 0) < 0:
                out.append((None, None, "void"))
            elif b is None:
                if was is None:
                    out.append((None, None, "unopened"))
                else:
                    out.append((was * RATE // 1000, e * RATE // 1000, "closed") if e > was else (None, None, "void"))
            elif was is not None or (last is not None and b < last) or (e is not None and e <= b):
                out.append((None, None, "nested" if was is not None else "rollback" if last is not None and b < last else "void"))
            elif e is not None:
                out.append((b * RATE // 1000, e * RATE // 1000, "complete"))
            if b is not None and e is None and b >= 0:
                opened = b
            # Only the end of a span that closes counts.
            if e is not None and out[-1:] and out[-1][2] in ("closed", "complete"):
                last = e if last is None else max(last, e)
        state.update((opened, last))
        yield pd.DataFrame(out, columns=["start", "stop", "outcome"]).astype({"start": "Int64", "stop": "Int64"}).assign(key=str(group[0]))[["key", "start", "stop", "outcome"]]

    rows = markers.select(F.col(key).cast("string").alias("key"), order, begin, end)
    return rows.groupBy("key").applyInPandasWithState(step, SPANS, _STATE, "append", GroupStateTimeout.NoTimeout)


CUTS = "key string, start long, stop long, pcm_start long, error string"
_CUTTER = "available long, watermark long, forced boolean, cursor long, pcm_start long, cut boolean, broken boolean"


def cuts(events: DataFrame, key: str, order: str, samples: str, begin: str, end: str) -> DataFrame:
    """Spans of a stream of (samples that came, begin at, end at), cut by ``SpeechCutter``; a key that breaks the protocol gives one error and no more."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cutter, broken, out = SpeechCutter(), False, []
        if state.exists:
            *kept, broken = state.get
            cutter = SpeechCutter(*kept)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for n, b, e in zip(rows[samples], rows[begin], rows[end]):
            if broken:
                break
            try:
                if not pd.isna(n):
                    cutter.advance(int(n))
                if not pd.isna(b):
                    cutter.begin(int(b))
                if not pd.isna(e):
                    cutter.complete(int(e))
            except ProtocolError as err:
                broken = True
                out += [(*s, None) for s in cutter.take()] + [(None, None, None, str(err))]
        out += [(*s, None) for s in cutter.take()]
        state.update((cutter.available, cutter.watermark, cutter.forced, cutter.cursor, cutter.pcm_start, cutter.cut, broken))
        frame = pd.DataFrame(out, columns=["start", "stop", "pcm_start", "error"]).astype({c: "Int64" for c in ("start", "stop", "pcm_start")})
        yield frame.assign(key=str(group[0]))[["key", "start", "stop", "pcm_start", "error"]]

    rows = events.select(F.col(key).cast("string").alias("key"), order, samples, begin, end)
    return rows.groupBy("key").applyInPandasWithState(step, CUTS, _CUTTER, "append", GroupStateTimeout.NoTimeout)


def _placed(events: DataFrame, time: str, late: str, seen: str | None, late_seconds: int) -> tuple[DataFrame, list[str]]:
    """``events`` with the time ``__t`` and its watermark, and the columns that say which rows are late."""
    t = F.col(time).cast("timestamp")
    if seen is None:
        return events.withColumn("__t", t).withWatermark("__t", late), []
    # A late row is placed where it was seen, which no watermark has passed, and is told by ``late``; so none is dropped.
    behind = _behind(time, seen) > late_seconds * 1_000_000
    rows = events.withColumn("late", F.coalesce(behind, F.lit(True)))
    return rows.withColumn("__t", F.when(F.col("late"), F.col(seen).cast("timestamp")).otherwise(t)).withWatermark("__t", f"{late_seconds} seconds"), ["late"]


def counts(events: DataFrame, time: str, keys: list[str], size: str = "10 minutes", late: str = "1 hour", seen: str | None = None, late_seconds: int = 3600) -> DataFrame:
    """Rows a tumbling window and key.

    With ``seen`` (when a row came) rows that came more than ``late_seconds`` after their time are counted apart, in the window they were seen in and with ``late`` true: none is dropped
    silently. Without it the watermark ``late`` behind the newest row drops what is later.
    """
    rows, more = _placed(events, time, late, seen, late_seconds)
    return rows.groupBy(F.window("__t", size).alias("w"), *keys, *more).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, *more, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour", seen: str | None = None, late_seconds: int = 3600) -> DataFrame:
    """Sessions of a key that a gap ends; the same plan serves a batch. Late rows as in ``counts``: with ``seen`` they have sessions of their own."""
    rows, more = _placed(events, time, late, seen, late_seconds)
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), key, *more).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *more, "n")


def _behind(time: str, seen: str) -> Column:
    return F.unix_micros(F.col(seen).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))


def with_late(df: DataFrame, time: str, seen: str, late_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows that came at most so many seconds after their time, and the others, so that none is dropped silently."""
    is_late = F.coalesce(_behind(time, seen) > late_seconds * 1_000_000, F.lit(True))
    return df.where(~is_late), df.where(is_late)
