"""Streams of start and end markers: pairing into spans, and what breaks the protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import to_samples
from .ordered import along
from .store import settle


def paired(markers: DataFrame, key: str, order: list[str], begin: str, end: str, span: float = 100_000_000) -> DataFrame:
    """Every marker (key, order, begin, end in ms; each may be NULL) with its ``outcome`` and, where a span closes, ``start`` and ``stop`` in samples.

    The protocol: a begin needs no open span and must not lie before the last end; an end needs an open span and must lie after its begin; a
    marker with both is a span of its own under the first rule. Outcomes: opened, closed, complete, or violation (nested, unopened,
    rollback, void). State is taken from the neighbour marker, so a violation is reported at the marker that breaks the rule with its
    predecessor and does not hide later ones.
    """
    kind = F.when(F.col(begin).isNotNull() & F.col(end).isNotNull(), "both").when(F.col(begin).isNotNull(), "begin").when(F.col(end).isNotNull(), "end").otherwise("none")
    rows = markers.withColumn("__kind", kind)
    rows = along(rows, key, order, span, prev={"__pk": F.col("__kind"), "__pb": F.col(begin)})
    begin_, end_, open_ = F.col(begin), F.col(end), F.coalesce(F.col("__pk") == "begin", F.lit(False))
    # Only the end of a span that closes counts as the last end; one that is void or unopened does not turn later begins into rollbacks.
    closes = F.when((F.col("__kind") == "end") & open_, end_ > F.col("__pb")).when((F.col("__kind") == "both") & ~open_, end_ > begin_)
    rows = settle(rows.withColumn("__end", F.when(closes & (end_ >= 0) & (F.coalesce(begin_, F.lit(0)) >= 0), end_)))
    rows = along(rows, key, order, span, top_before={"__last": F.col("__end")}).drop("__end")
    back = F.coalesce(begin_ < F.col("__last"), F.lit(False))
    outcome = (
        F.when((F.col("__kind") == "none") | (F.coalesce(begin_, F.lit(0)) < 0) | (F.coalesce(end_, F.lit(0)) < 0), "void")
        .when((F.col("__kind") == "end") & ~open_, "unopened")
        .when((F.col("__kind") == "end") & (end_ <= F.col("__pb")), "void")
        .when(F.col("__kind") == "end", "closed")
        .when(open_, "nested")
        .when(back, "rollback")
        .when((F.col("__kind") == "both") & (end_ <= begin_), "void")
        .when(F.col("__kind") == "both", "complete")
        .otherwise("opened")
    )
    rows = rows.withColumn("outcome", outcome)
    start = F.when(F.col("outcome") == "closed", F.col("__pb")).when(F.col("outcome") == "complete", begin_)
    return rows.withColumn("start", to_samples(start)).withColumn("stop", to_samples(F.when(F.col("outcome").isin("closed", "complete"), end_))).drop("__kind", "__pk", "__pb", "__last")
