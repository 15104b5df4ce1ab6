"""Spectral clustering of one recording's windows into anonymous speakers.

The reference admits 30 minutes and so about 2,400 windows. With more, the affinity matrix is never built: without pruning it is the
product of the windows with themselves, of rank ``dim``, so that eigenvalues below any value can be counted exactly in memory of the windows alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import usable

LONGEST = 28_800_000
#: Windows up to which the affinity matrix is built; the reference's bound gives as many.
DENSE = 2_400
#: Rows of a recording up to which it is clustered: 52 hours of windows, some 800 MB in its task.
MOST = 250_000
RESTARTS, ROUNDS = 10, 300


def affinity(x: np.ndarray, keep: float = 1.0) -> np.ndarray:
    """Cosines of unit rows; of each row the lowest are zeroed (ties by position), all but a share ``keep`` yet never so that fewer than 6 stay; then
    symmetric, with a zero diagonal."""
    a, n = x @ x.T, len(x)
    drop = max(0, min(int((1 - keep) * n), n - 6))
    if drop:
        low = np.argsort(a, axis=1, kind="stable")[:, :drop]
        np.put_along_axis(a, low, 0.0, axis=1)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0.0)
    return a


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, degrees) of the Laplacian; degrees are sums of absolute affinities. Rounding below 0 is cleared, more is an error."""
    degree = np.abs(a).sum(1)
    laplacian = np.diag(degree) - a
    values, vectors = np.linalg.eigh(laplacian)
    slack = np.finfo(np.float64).eps * len(a) * np.abs(laplacian).sum(1).max()
    if values.min() < -slack:
        raise ValueError("the Laplacian is not positive")
    return np.maximum(values, 0.0), vectors, degree


def count(values: np.ndarray, degree: np.ndarray, low: float = 2.0, gap: float = 0.5) -> int:
    """Number of clusters: of the k from 2 to n-1 whose eigenvalue is at most ``low`` times the median degree, the first with the largest
    relative step up to it, if that step is at least ``gap``; else 1."""
    best, found = -np.inf, 1
    for k in range(2, len(values)):
        if values[k] <= low * np.median(degree):
            step = (values[k] - values[k - 1]) / max(abs(values[k]), 1e-12)
            if step >= gap and step > best:
                best, found = step, k
    return found


class Product:
    """The Laplacian of unit rows ``x`` without pruning, as the diagonal ``own`` less ``x @ x.T``; it is never built.

    By Sylvester's law the eigenvalues below s are as many as the negative ones of own - s and of the small matrix I - x.T @ (x / (own - s)).
    """

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        size = (x**2).sum(1)
        self.degree = np.empty(n)
        step = max(1, 4_000_000 // n)
        for i in range(0, n, step):
            self.degree[i : i + step] = np.abs(x[i : i + step] @ x.T).sum(1)
        self.degree -= size
        self.own = self.degree + size
        self.slack = np.finfo(np.float64).eps * n * 2 * self.degree.max()

    def _shifted(self, s: float) -> tuple[np.ndarray, np.ndarray]:
        f = self.own - s
        f[f == 0] = self.slack
        return f, np.eye(self.x.shape[1]) - self.x.T @ (self.x / f[:, None])

    def below(self, s: float) -> int:
        """Number of eigenvalues below ``s``."""
        f, small = self._shifted(s)
        return int((f < 0).sum() + (np.linalg.eigvalsh(small) < 0).sum())

    def _value(self, k: int, a: float, b: float) -> float:
        """Eigenvalue ``k`` (from 0), which lies from ``a`` to ``b``."""
        while b - a > 1e-12 * b and b > self.slack:
            s = (a + b) / 2
            a, b = (a, s) if self.below(s) > k else (s, b)
        return (a + b) / 2

    def count(self, low: float, gap: float) -> int:
        """As ``count`` of all eigenvalues. A step of ``gap`` or more holds a whole cell of a grid of half its ratio, so cells without an eigenvalue
        give all candidates. Steps among values within rounding of 0 are not told apart."""
        if self.below(-self.slack):
            raise ValueError("the Laplacian is not positive")
        top = np.nextafter(low * np.median(self.degree), np.inf)
        ratio = (1 - gap) ** 0.5
        grid = [top]
        while grid[-1] > self.slack:
            grid.append(grid[-1] * ratio)
        under = [self.below(s) for s in grid]
        best, found = -np.inf, 1
        # From below, and so with k rising.
        for k in sorted(set(under[1:])):
            cells = [i for i, n in enumerate(under) if n == k]
            if len(cells) < 2 or cells[0] == 0 or not 2 <= k < len(self.x):
                continue
            a, b = cells[-1], cells[0]
            upper = self._value(k, grid[b], grid[b - 1])
            lower = self._value(k - 1, grid[a + 1] if a + 1 < len(grid) else 0.0, grid[a])
            step = (upper - lower) / max(upper, 1e-12)
            if step >= gap and step > best:
                best, found = step, k
        return found

    def lowest(self, k: int) -> np.ndarray:
        """The eigenvectors of the ``k`` lowest eigenvalues, which a step parts from the rest, by inverse iteration of a subspace."""
        b = self._value(k, 0.0, 2 * self.own.max())
        f, small = self._shifted(-b / 16)
        scaled = self.x / f[:, None]
        inverse = np.linalg.inv(small)
        y = np.linalg.qr(np.random.Generator(np.random.PCG64(0)).standard_normal((len(self.x), k)))[0]
        for _ in range(500):
            z = y / f[:, None]
            z += scaled @ (inverse @ (self.x.T @ z))
            z = np.linalg.qr(z)[0]
            off = np.linalg.norm(z - y @ (y.T @ z))
            y = z
            if off < 1e-12 * k:
                return y
        raise ValueError("the eigenvectors do not settle")


def kmeans(y: np.ndarray, k: int) -> np.ndarray:
    """The assignment of least inertia of ten seeded starts; starts that empty a cluster or do not settle are dropped. None left is an error."""
    best, found = np.inf, None
    for seed in range(RESTARTS):
        rng = np.random.Generator(np.random.PCG64(seed))
        centres = [y[rng.integers(len(y))]]
        near = ((y - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            steps = np.cumsum(near)
            # With no distance left there is no further centre, and the start is dropped.
            if not steps[-1] > 0:
                break
            centres.append(y[min(np.searchsorted(steps, rng.random() * steps[-1], "right"), len(y) - 1)])
            near = np.minimum(near, ((y - centres[-1]) ** 2).sum(1))
        if len(centres) < k:
            continue
        c, last = np.array(centres), None
        for _ in range(ROUNDS):
            far = np.maximum((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1), 0)
            now = far.argmin(1)
            if np.bincount(now, minlength=k).min() == 0:
                break
            if last is not None and (now == last).all():
                inertia = far[np.arange(len(y)), now].sum()
                if inertia < best:
                    best, found = inertia, now
                break
            last, c = now, np.array([y[now == i].mean(0) for i in range(k)])
    if found is None:
        raise ValueError("no start of k-means settled")
    return found


def clustered(x: np.ndarray, keep: float = 1.0, low: float = 2.0, gap: float = 0.5, dense: int = DENSE) -> np.ndarray:
    """Ordinals of unit rows, numbered by first member; up to two rows are one cluster."""
    n = len(x)
    if n <= 2:
        return np.zeros(n, np.int64)
    # Pruned rows are of no low rank, so with them the whole matrix is built whatever its size.
    if n > dense and keep >= 1:
        product = Product(x)
        k = product.count(low, gap)
        vectors = product.lowest(k) if k > 1 else None
    else:
        values, vectors, degree = spectrum(affinity(x, keep))
        k = count(values, degree, low, gap)
    if k == 1:
        return np.zeros(n, np.int64)
    labels = kmeans(vectors[:, :k], k)
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def by_recording(windows: DataFrame, key: str = "job_id", vector: str = "embedding", dim: int = 192, longest: int | None = LONGEST, most: int = MOST, keep: float = 1.0, low: float = 2.0, gap: float = 0.5) -> DataFrame:
    """(key, start, ordinal, error) of the usable windows of each recording; of windows with one start the first by content counts.

    A recording whose rows end after ``longest`` samples (None: any length is admitted) or are more than ``most`` is refused whole before any vector moves: its windows come out with a NULL
    ordinal and the error ``too_long`` or ``too_many``; so do those of a recording that cannot be clustered, with ``unsettled``. No other recording is touched by it.
    """
    said = F.when(F.col("e") > (longest if longest is not None else 1 << 62), "too_long").when(F.col("n") > most, "too_many")
    bounds = windows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("end_sample").alias("e"), F.count("*").alias("n"))
    over = bounds.select(key, said.alias("error")).where("error is not null")
    rows = windows.where(F.col(key).isNotNull() & usable(F.col(vector), dim)).select(key, F.col("start_sample").alias("start"), F.col(vector).alias("v"))
    refused = rows.join(over, key).select(key, "start", F.lit(None).cast("long").alias("ordinal"), "error").distinct()
    rows = rows.join(over.select(key), key, "left_anti")
    # A recording ends up in one task anyway, so its vectors move once.
    rows = rows.select(key, "start", "v").repartition(key).groupBy(key, "start").agg(F.min("v").alias("v"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        x = np.stack(part["v"].to_list()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        made = pd.DataFrame({key: part[key], "start": part["start"], "ordinal": pd.array([None] * len(part), "Int64"), "error": None})
        try:
            made["ordinal"] = pd.array(clustered(x, keep, low, gap), "Int64")
        except (ValueError, np.linalg.LinAlgError):
            made["error"] = "unsettled"
        return made

    done = rows.groupBy(key).applyInPandas(run, f"`{key}` string, start long, ordinal long, error string")
    return done.unionByName(refused)
