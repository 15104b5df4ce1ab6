"""The integer sample clock of 16,000 a second, UTC instants and sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RATE = 16_000
QUANTUM = 8 * 1024 * 1024


def to_samples(ms: Column) -> Column:
    return ms * (RATE // 1000)


def to_seconds(samples: Column) -> Column:
    return samples / F.lit(float(RATE))


def instant(ts: Column) -> Column:
    """A UTC instant as text: no fraction where there is none, else six digits."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def fixed_instant(ts: Column) -> Column:
    """A UTC instant as text with six digits of fraction always, so that text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, not below 0; null where one is unknown."""
    return F.greatest(F.unix_micros(end) - F.unix_micros(start), F.when(start.isNotNull() & end.isNotNull(), F.lit(0))) / 1000


def reserved(size: Column) -> Column:
    """A size rounded up to whole quanta of 8 MiB, at least one."""
    return F.greatest(F.lit(QUANTUM), F.ceil(size / F.lit(QUANTUM)) * QUANTUM).cast("long")


def due(finished: Column, now: Column, hours: int) -> Column:
    """Whether something finished at least so many hours before ``now``; what has not finished is never due."""
    return F.coalesce(F.unix_micros(finished) <= F.unix_micros(now) - hours * 3_600_000_000, F.lit(False))
