"""Matching anonymous clusters with known speakers, and checks on enrolled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import cosine, mean_unit, usable

#: Profiles at most; the bound of what is sent to every task.
PROFILES = 256


def best_known(clusters: DataFrame, profiles: DataFrame, key: list[str], vector: str = "centroid", dim: int = 192, threshold: float = 0.31) -> DataFrame:
    """(key, id, name, similarity): of each cluster the profile of the highest cosine, if it reaches the threshold and no other is equal.

    Clusters with an unusable vector, or none that reaches the threshold, have NULLs; so has an exact tie. ``profiles`` has id, name and
    embedding (array of floats); more than ``PROFILES`` of them are an error, as they are sent to every task.
    """
    known = profiles.where(usable(F.col("embedding"), dim)).select("id", "name", "embedding").orderBy("id").limit(PROFILES + 1).collect()
    if len(known) > PROFILES:
        raise ValueError(f"more than {PROFILES} profiles")
    ids, names = [r["id"] for r in known], [r["name"] for r in known]
    matrix = np.array([r["embedding"] for r in known], np.float64).reshape(-1, dim)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = clusters.sparkSession.sparkContext.broadcast((ids, names, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, names, matrix = shared.value
        for batch in batches:
            out = batch[key].copy()
            best_id, best_name, best = [None] * len(batch), [None] * len(batch), np.full(len(batch), np.nan)
            for i, v in enumerate(batch[vector]):
                if v is None or not len(ids):
                    continue
                x = np.asarray(v, np.float64)
                like = np.clip(matrix @ (x / np.linalg.norm(x)), -1, 1)
                top = like.argmax()
                if like[top] >= threshold and (like == like[top]).sum() == 1:
                    best_id[i], best_name[i], best[i] = ids[top], names[top], like[top]
            yield out.assign(id=best_id, name=best_name, similarity=pd.Series(best, index=out.index).astype(object).where(~np.isnan(best), None))

    rows = clusters.select(*key, F.when(usable(F.col(vector), dim), F.col(vector)).alias(vector))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", id string, name string, similarity double")


def mean_of_means(samples: DataFrame, speaker: str, sample: str, vector: str, dim: int) -> DataFrame:
    """(speaker, centroid, n): the mean of each speaker's sample means, each sample weighing alike however many vectors it has."""
    return mean_unit(mean_unit(samples, [speaker, sample], vector, dim).where("centroid is not null"), [speaker], "centroid", dim)


def consistency(samples: DataFrame, speaker: str, sample: str, vector: str, dim: int, threshold: float = 0.31) -> DataFrame:
    """(speaker, pairs, least, consistent): the least cosine between the sample means of a speaker, against the threshold.

    A speaker's samples are 2 to 5; those of others have no pair or are an error of the caller, told by ``pairs``.
    """
    means = mean_unit(samples, [speaker, sample], vector, dim).where("centroid is not null")
    a = means.select(speaker, F.col(sample).alias("__a"), F.col("centroid").alias("__x"))
    b = means.select(speaker, F.col(sample).alias("__b"), F.col("centroid").alias("__y"))
    pairs = a.join(b, speaker).where("__a < __b").select(speaker, cosine(F.col("__x"), F.col("__y")).alias("c"))
    return pairs.groupBy(speaker).agg(F.count("*").alias("pairs"), F.min("c").alias("least")).withColumn("consistent", F.col("least") >= threshold)
