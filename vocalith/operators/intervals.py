"""Half-open intervals [start, end) on the sample clock, per recording.

Every function takes a key column and the columns named ``start`` and ``end`` (BIGINT). Intervals that are void
(end <= start) or have a NULL are dropped first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import SPAN, along
from .store import settle

WINDOW, HOP = 24_000, 12_000
LONGEST = 480_000
BLOCK = 9_600


def valid(df: DataFrame, key: str = "job_id") -> DataFrame:
    return df.where(f"`{key}` is not null and start is not null and end > start")


def islands(df: DataFrame, key: str = "job_id", span: int = SPAN) -> DataFrame:
    """(key, start, end): the union of a key's intervals as maximal islands; touching intervals join."""
    rows = valid(df, key).select(key, "start", "end").distinct()
    rows = along(rows, key, ["start", "end"], span, top_before={"reach": F.col("end")})
    # Written once here: a second ordered step on top would run the first one twice.
    rows = settle(rows.withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))).drop("reach"))
    # The island of a row is the latest start that opened one.
    rows = along(rows, key, ["start", "end"], span, last={"open": F.col("fresh")})
    rows = rows.withColumn("island", F.coalesce("fresh", "open"))
    return rows.groupBy(key, "island").agg(F.max("end").alias("end")).select(key, F.col("island").alias("start"), "end")


def overlaps(left: DataFrame, right: DataFrame, key: str = "job_id", bucket: int = 960_000) -> DataFrame:
    """Each pair of a left and a right interval of one key with a positive overlap, as columns l, r (structs), start, end.

    An equi-join on (key, bucket of the clock): each interval stands in every bucket it touches and a pair counts in the bucket where
    the overlap starts, so a long recording is spread over its buckets and no pair comes out twice.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        rows = valid(df, key).select(F.struct("*").alias(name), F.col(key).alias("__k"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("__b"))
        return rows

    both = spread(left, "l").join(spread(right, "r"), ["__k", "__b"])
    begin, stop = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    return both.where((begin < stop) & (F.floor(begin / bucket) == F.col("__b"))).select(F.col("__k").alias(key), "l", "r", begin.alias("start"), stop.alias("end"))


def coverage(left: DataFrame, right: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, start, end, covered): of each left interval the samples that the union of the right ones covers; 0 where none does."""
    left = valid(left, key).select(key, "start", "end").distinct()
    found = overlaps(left, islands(right, key), key).groupBy(F.col(key), F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(F.sum(F.expr("`end` - `start`")).alias("covered"))
    return left.join(found, [key, "start", "end"], "left").select(key, "start", "end", F.coalesce("covered", F.lit(0)).alias("covered"))


def hop_windows(df: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, start, end): the windows of 24,000 samples on multiples of 12,000 that overlap any of a key's intervals, each once.

    The anchors of an interval have a closed form, so no join is needed.
    """
    low = F.greatest(F.lit(0), F.floor((F.col("start") - WINDOW) / HOP) + 1)
    high = F.floor((F.col("end") - 1) / HOP)
    anchors = valid(df, key).where("start >= 0").select(key, F.explode(F.sequence(low, high)).alias("j")).distinct()
    return anchors.select(key, (F.col("j") * HOP).alias("start"), (F.col("j") * HOP + WINDOW).alias("end"))


def tail_windows(df: DataFrame, length: Column) -> DataFrame:
    """``df`` with one row a window (start, end) of 24,000 at hops of 12,000 within a length, and one more that ends at it.

    A length up to 24,000 has one window of its own size; one below 1 or NULL has none.
    """
    n = length.cast("long")
    starts = F.when(n <= WINDOW, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n - WINDOW, F.lit(HOP).cast("long")), F.array(n - WINDOW))))
    return df.where(n >= 1).select("*", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + WINDOW, n))


def cells(df: DataFrame, total: str, key: str = "job_id", span: int = SPAN) -> DataFrame:
    """``df`` (a row a window with ``start``, distinct per key) with the cell [cell_start, cell_end) nearest to each window's centre.

    Boundaries lie midway between neighbouring centres, the first at 0 and the last at the column ``total``; they are
    monotone, so clipping to [0, total] is all they need.
    """
    rows = along(df, key, ["start"], span, prev={"__p": F.col("start")}, next={"__n": F.col("start")})
    middle = lambda a, b: F.greatest(F.lit(0), F.least(F.col(total), F.expr(f"({a} + {b} + 1) div 2 + {WINDOW // 2}")))
    return rows.withColumns({
        "cell_start": F.when(F.col("__p").isNull(), F.lit(0).cast("long")).otherwise(middle("__p", "start")),
        "cell_end": F.when(F.col("__n").isNull(), F.col(total)).otherwise(middle("start", "__n")),
    }).drop("__p", "__n")


def merged(df: DataFrame, label: str, key: str = "job_id", within: str | None = None, span: int = SPAN) -> DataFrame:
    """(key, [within], label, start, end, n): runs of touching intervals (start = end before) of one label, inside one ``within`` only."""
    same = [label] + ([within] if within else [])
    rows = valid(df, key).select(key, *same, "start", "end").distinct()
    rows = along(rows, key, ["start", "end"], span, prev={"__p": F.struct("end", *same)})
    goes_on = (F.col("__p.end") == F.col("start"))
    for c in same:
        goes_on = goes_on & F.col(f"__p.{c}").eqNullSafe(F.col(c))
    rows = settle(rows.withColumn("__f", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("start"))).drop("__p"))
    rows = along(rows, key, ["start", "end"], span, last={"__o": F.col("__f")}).withColumn("__run", F.coalesce("__f", "__o"))
    out = rows.groupBy(key, *same, "__run").agg(F.max("end").alias("end"), F.count("*").alias("n"))
    return out.select(key, *same, F.col("__run").alias("start"), "end", "n")


def split(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``df`` with intervals longer than ``longest`` cut at its multiples from their own start, and ``piece`` from 0."""
    rows = df.where("end > start").select(*[c for c in df.columns if c not in ("start", "end")], F.col("end").alias("__e"), F.posexplode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(longest).cast("long"))).alias("piece", "start"))
    return rows.withColumn("end", F.least(F.col("start") + longest, F.col("__e"))).drop("__e")


def blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """``df`` with each interval cut at the multiples of ``size`` on the clock, and the number ``block`` of each."""
    rows = df.where("end > start").select(*[c for c in df.columns if c not in ("start", "end")], F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("block"))
    return rows.withColumn("start", F.greatest("__s", F.col("block") * size)).withColumn("end", F.least("__e", (F.col("block") + 1) * size)).drop("__s", "__e")
