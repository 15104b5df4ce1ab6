"""Vectors as arrays: built-in higher-order functions, so that they stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector is ``dim`` finite numbers that are not all zero; null is not."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dim) & finite & (norm(a) > 0), F.lit(False))


def is_unit(a: Column, dim: int, tolerance: float = 1e-5) -> Column:
    return usable(a, dim) & (F.abs(norm(a) - 1) <= tolerance)


def unit(a: Column) -> Column:
    """The vector at length one."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two usable vectors, clamped to [-1, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (norm(a) * norm(b))))


def mean_unit(df: DataFrame, keys: list[str], vector: str, dim: int, name: str = "centroid") -> DataFrame:
    """(keys, centroid, n): the element-wise mean of each key's vectors at length one, null where the mean is zero.

    One sum a dimension, combined before the shuffle: what moves is one array a key and task, however many rows a key has.
    """
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("s"))
    mean = F.transform("s", lambda x: x / F.col("n"))
    return sums.select(*keys, F.when(norm(F.col("s")) > 0, unit(mean)).alias(name), "n")


def group_means(df: DataFrame, key: str, vector: str, dim: int, name: str = "centroid", scaled: bool = True) -> DataFrame:
    """(key, n, centroid): as ``mean_unit``, of the rows at length one if ``scaled``, for a BIGINT or STRING key and many groups.

    Arrow batches are summed by key within their task and what is left moves once, sorted by key; NULL keys are a group of their own.
    ``vector`` must be usable.
    """
    kind = dict(df.dtypes)[key]

    def sums(ordered: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, n = batch.column(0), np.asarray(batch.column(1))
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                if scaled and not ordered:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes = keys.dictionary_encode(null_encoding="encode")
                index = np.asarray(codes.indices)
                order = np.argsort(index, kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
                made = codes.dictionary.take(pa.array(index[order][start])).to_pylist(), np.add.reduceat(n[order], start), np.add.reduceat(x[order], start, axis=0)
                # Sorted rows: the last key of a batch may go on in the next one.
                if ordered:
                    made = [list(y) for y in made]
                    if held is not None:
                        if held[0] == made[0][0]:
                            made[1][0], made[2][0] = made[1][0] + held[1], made[2][0] + held[2]
                        else:
                            made = [[h, *y] for h, y in zip(held, made)]
                    held = tuple(y.pop() for y in made)
                yield pack(*made)
            if held is not None:
                yield pack(*([h] for h in held))

        return run

    def pack(keys: list, n: list, x: list) -> pa.RecordBatch:
        flat = pa.array(np.asarray(x, np.float64).reshape(-1))
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dim, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string() if kind == "string" else pa.int64()), pa.array(list(n), pa.int64()), arrays], [key, "n", "s"])

    schema = f"`{key}` {kind}, n long, s array<double>"
    rows = df.select(key, F.lit(1).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("s"))
    part = rows.mapInArrow(sums(False), schema)
    whole = part.repartition(key).sortWithinPartitions(key).mapInArrow(sums(True), schema)
    mean = F.transform("s", lambda x: x / F.col("n"))
    return whole.select(key, "n", F.when(norm(F.col("s")) > 0, unit(mean)).alias(name))


def positive_zero(x: Column) -> Column:
    """A number with negative zero as zero; NULL for what is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a BINARY; NULL where its length is no multiple of four. A batch is read at once."""
    sizes = blob.map(len, na_action="ignore").fillna(-1).astype(int).to_numpy()
    good = (sizes >= 0) & (sizes % 4 == 0)
    flat = np.frombuffer(b"".join(blob[good]), "<f4")
    out = np.full(len(blob), None, object)
    out[np.flatnonzero(good)] = [*np.split(flat, np.cumsum(sizes[good] // 4)[:-1]), None][: good.sum()] if good.any() else []
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def to_blob(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")
