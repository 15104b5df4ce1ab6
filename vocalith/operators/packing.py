"""Greedy packing of ordered segments into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST, MOST_SAMPLES, MOST_SPAN = 32, 960_000, 4_800_000


def packed(df: DataFrame, key: str = "job_id", order: str = "segment_index", most: int = MOST, samples: int = MOST_SAMPLES, span: int = MOST_SPAN) -> DataFrame:
    """(key, order, batch_no): a batch is closed before the row that would take it beyond a bound: so many rows, samples in all, or samples
    from the first start to the end of the row. A single row beyond a bound is a batch of its own.

    Needs ``start`` and ``end``. A key's rows stream in order through one task that holds only the open batch's counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, no, n, total, first = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for k, s, e in zip(batch[key], batch["start"], batch["end"]):
                if k != key_now:
                    key_now, no, n = k, 0, 0
                elif n + 1 > most or total + e - s > samples or e - first > span:
                    no, n = no + 1, 0
                if n == 0:
                    total, first = 0, s
                n, total = n + 1, total + e - s
                out.append(no)
            yield pd.DataFrame({key: batch[key], order: batch[order], "batch_no": out})

    rows = df.where(f"`{key}` is not null and end > start").select(key, order, "start", "end")
    kinds = dict(rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch_no long")
