"""Least labels over the edges of a graph, to convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.store import settle


def _ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends."""
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _mark(edges: DataFrame) -> tuple:
    """Number of distinct edges and two sums of their hashes: equal for equal sets, and for others only by a chance of about 2 to the power -128."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")), F.lit(0)) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def least_labels(edges: DataFrame) -> DataFrame:
    """(id, label) of each vertex of ``edges`` (a, b): label is the least id of its component.

    Large-star and small-star rounds: each vertex hands its neighbours to the least of them, until every component
    is a star about its least vertex. A hub's edges shrink by half or more a round and no vertex's neighbours are gathered: a
    round is two groupings by vertex with partial aggregation and two joins. Each round is written to the checkpoint
    folder; the number of rounds grows with the logarithm of a component's diameter.
    """
    star = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(star)
    while True:
        both = _ways(star)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        after = settle(small.where("u <> v").distinct())
        # Done when the edges have stayed the same.
        was, mark, star = mark, _mark(after), after
        if mark == was:
            break
    # A centre is its own label.
    return star.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("label")), F.struct(F.col("v").alias("id"), F.col("v").alias("label"))))).distinct()
