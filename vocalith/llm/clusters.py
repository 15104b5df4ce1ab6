"""Vectors into groups of mutually similar ones, by density over grids of quantised features.

Features are the coordinates of a vector in a random rotation; a cell of the grid is the signed axis of the largest one, and a vector near
the border of its cell counts in the adjacent one too (the axes of the next largest). Cells are counted; those that hold at least two like vectors
are dense. Dense cells that share a vector are adjacent and join; least labels are propagated over them to convergence. 192 raw coordinates would give cells of
one vector each, so the grid is laid over many rotations. An exact check follows in each cell: vectors are compared with the cell's heads (the first
vector of each group in it) by cosine. Vectors travel as 8-bit integers, whose error of the cosine (below 0.005) is far less than
the margin between the two bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import cosine, group_means, usable
from ..operators.store import settle
from .components import least_labels

SEED = 20_240_501
#: Of a grid of so many rotations a cell: the axes taken in each, and the chance that two vectors of one group at the lower bound (cosine 0.7) share a cell (measured as 0.385, 0.335 and 0.194, rounded down).
GRIDS = {1: (2, 0.38), 2: (3, 0.33), 3: (3, 0.19)}
#: Grids of the first round, which leaves one vector of what it joins for the second.
FIRST = 5
#: Rows compared at once; bounds the memory of a task.
BLOCK = 4096
#: Rows of one cell of the thinning grid that one task takes, on average.
SHARE_ROWS = 100_000
#: A cell of the other grids is crowded if it holds more than so many rows and more than one in so many of all rows; so there are at most as many crowded cells.
CROWD_ROWS, CROWD_SHARE = 50_000, 10_000


def _rotation(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng(SEED + table).standard_normal((dim, dim), dtype=np.float32)


def _cells(x: np.ndarray, table: int, depth: int, axes: int = 1) -> np.ndarray:
    """The cells of each row in one grid (rows x axes**depth): of each of ``depth`` rotations the signed axes of the largest coordinates."""
    cells = np.full((len(x), 1), table, np.int64)
    for i in range(depth):
        y = x @ _rotation(x.shape[1], table * 8 + i)
        size = np.abs(y)
        top = np.argpartition(size, -axes, axis=1)[:, -axes:] if axes > 1 else size.argmax(1)[:, None]
        signed = 2 * top + (np.take_along_axis(y, top, 1) > 0)
        cells = (cells[:, :, None] * (2 * x.shape[1]) + signed[:, None]).reshape(len(x), -1)
    return cells


def _pack(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int8) if len(column) else np.empty(0, np.int8)
    x = flat.reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _heads(x: np.ndarray, close: float) -> np.ndarray:
    """Of each row the first row like it, up to itself. Likeness being transitive between the two bounds, that is its group's first row."""
    return (x @ x.T >= close).argmax(1)


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows that are ``dim`` finite numbers, not all zero, and the rows at unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    top = np.abs(x).max(1, initial=0)
    good = np.isfinite(top) & (top > 0)
    x = x[good] / top[good, None]
    return at[good], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class _Cell:
    """Heads of one cell while its rows stream by, in blocks."""

    def __init__(self, close: float):
        self.close, self.cell, self.heads = close, None, []

    def assign(self, cell: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        if cell != self.cell:
            self.cell, self.heads = cell, []
        out = np.empty(len(ids), np.int64)
        for s in range(0, len(ids), BLOCK):
            part, own = x[s : s + BLOCK], ids[s : s + BLOCK]
            got, open_ = np.empty(len(part), np.int64), np.arange(len(part))
            for known, rows in self.heads:
                like = part[open_] @ rows.T
                best = like.argmax(1)
                hit = like[np.arange(len(open_)), best] >= self.close
                got[open_[hit]] = known[best[hit]]
                open_ = open_[~hit]
                if not len(open_):
                    break
            if len(open_):
                first = _heads(part[open_], self.close)
                got[open_] = own[open_[first]]
                new = open_[first == np.arange(len(open_))]
                self._keep(own[new], part[new])
            out[s : s + BLOCK] = got
        return out

    def _keep(self, ids: np.ndarray, rows: np.ndarray) -> None:
        # Small blocks are joined, so that rows are copied a logarithmic number of times.
        while self.heads and len(self.heads[-1][0]) <= len(ids) and len(ids) < BLOCK:
            known, kept = self.heads.pop()
            ids, rows = np.concatenate([known, ids]), np.concatenate([kept, rows])
        self.heads.append((ids, rows))


def _bounds(cell: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.array([0])


def similarity_groups(
    vectors: DataFrame, id_col: str, vector_col: str, dim: int = 192, close: float = 0.675, missed: float = 1e-4, cell_rows: int = 16_000, alone: bool = True
) -> DataFrame:
    """(group_id, vector_id, cell) of each usable vector; group_id is the least vector_id of the group, cell its cell in the thinning grid.

    Without ``alone``, vectors that are like no other are left out.

    Vectors whose cosine is at least ``close`` belong together; there must be a margin about ``close`` in which no cosine
    lies (here 0.65 to 0.7). Usable is a vector of ``dim`` finite numbers that are not all zero; rows with a null id or
    an unusable vector are left out, and rows of equal id are one vector (of differing copies, each is placed and the
    least group is kept). ``missed`` bounds the chance that two given like vectors share no cell of the last round; it sets the number of
    grids at every depth alike. The depth of a cell is the least at which a cell holds ``cell_rows`` rows on average, so that the
    vectors compared with each one stay bounded however many there are.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One head a group and cell of each batch, with its members: a group that holds most rows is thinned before any shuffle.
        for batch in batches:
            known = batch.column(0).is_valid()
            batch = batch.filter(known)
            at, x = _usable(batch.column(1), dim)
            ids = np.asarray(batch.column(0))[at]
            cell = _cells(x, 0, 1)[:, 0] if len(x) else np.empty(0, np.int64)
            order = np.lexsort((ids, cell))
            cell, ids, x = cell[order], ids[order], x[order]
            state, heads = _Cell(close), ids.copy()
            edges = _bounds(cell)
            for s, e in zip(edges, edges[1:]):
                heads[s:e] = state.assign(cell[s], ids[s:e], x[s:e])
            by = np.lexsort((ids, heads, cell))
            cell, ids, x, heads = cell[by], ids[by], x[by], heads[by]
            start = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]) | (cell[1:] != cell[:-1])]) if len(ids) else np.empty(0, np.int64)
            members = pa.LargeListArray.from_arrays(pa.array(np.r_[start, len(ids)], pa.int64()), pa.array(ids, pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell[start]), pa.array(heads[start], pa.int64()), _binary(_pack(x[start])) if len(start) else pa.array([], pa.binary()), members], ["cell", "id", "v", "members"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Cell(close)
        for batch in batches:
            cell, ids = (np.asarray(batch.column(0)) << 32) + np.asarray(batch.column(4)), np.asarray(batch.column(1))
            heads, x, edges = ids.copy(), _unpack(batch.column(2), dim), _bounds(cell)
            for s, e in zip(edges, edges[1:]):
                heads[s:e] = state.assign(cell[s], ids[s:e], x[s:e])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads), batch.column(2), batch.column(3)], ["cell", "id", "head", "v", "members"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    thinned = settle(rows.mapInArrow(local, "cell long, id long, v binary, members array<long>"))
    # The thinning grid only thins further, so a cell that holds many rows may be cut into shares; what is apart there meets in the grids to come.
    counted = thinned.groupBy("cell").count().where(F.col("count") > SHARE_ROWS)
    shares = F.coalesce(F.ceil(F.col("count") / SHARE_ROWS), F.lit(1))
    spread = thinned.join(F.broadcast(counted), "cell", "left").withColumn("share", F.pmod(F.xxhash64("id"), shares)).drop("count")
    placed = settle(spread.repartition("cell", "share").sortWithinPartitions("cell", "share", "id").select("cell", "id", "v", "members", "share").mapInArrow(gathered, "cell long, id long, head long, v binary, members array<long>"))
    heads = placed.where("id = head").select("id", "v")
    first = _joined(heads, heads.count(), 1, FIRST, dim, close, 1)
    # One vector of each group so far goes on: it is like all of its group, so no link is lost.
    left = settle(heads.join(first.where("id <> label").select("id"), "id", "left_anti"))
    n, depth = left.count(), 1
    while depth < max(GRIDS) and n * GRIDS[depth][0] ** depth / (2 * dim) ** depth > cell_rows:
        depth += 1
    grids = math.ceil(math.log(missed) / math.log(1 - GRIDS[depth][1]))
    second = _joined(left, n, depth, grids, dim, close, 1 + FIRST)
    labels = first.select("id", F.col("label").alias("one")).join(second.select(F.col("id").alias("one"), F.col("label").alias("two")), "one", "full")
    labels = labels.select(F.coalesce("id", "one").alias("id"), F.coalesce("two", "one").alias("label"))
    whole = placed.select("cell", "head", "members").join(labels, F.col("head") == F.col("id"), "left")
    whole = whole.select(F.coalesce("label", "head").alias("group_id"), "cell", "members")
    if not alone:
        spans = whole.groupBy("group_id").agg(F.min(F.array_min("members")).alias("lo"), F.max(F.array_max("members")).alias("hi"))
        whole = whole.join(spans.where("lo < hi").select("group_id"), "group_id", "left_semi")
    out = whole.select("group_id", "cell", F.explode("members").alias("vector_id"))
    # Copies of one vector fall into one cell and group; the grouping also settles differing copies.
    return out.groupBy("vector_id").agg(F.min(F.struct("group_id", "cell")).alias("g")).select("g.group_id", "vector_id", "g.cell")


def _joined(heads: DataFrame, n: int, depth: int, grids: int, dim: int, close: float, base: int) -> DataFrame:
    """(id, label) of the vectors (id, v) that lie in a dense cell of one of the grids: the least id of the dense cells that are adjacent through shared vectors.

    Cells are counted first, without vectors. A cell's rows stream through one task; a crowded cell is cut into blocks by a hash of the id, and each pair of blocks is a cell of its own, so that
    all of its vectors still meet. The part of a cell that is like one head is a dense cell. A vector's dense cells are few: as many as the grids' cells at most.
    """
    axes = GRIDS[depth][0]

    def quantised(bare: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unpack(batch.column(1), dim)
                for t in range(base, base + grids) if len(x) else ():
                    cells = _cells(x, t, depth, axes)
                    for k in range(cells.shape[1]):
                        columns = [pa.array(cells[:, k])] + ([] if bare else [batch.column(0), batch.column(1)])
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "v"][: len(columns)])

        return run

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Cell(close)
        for batch in batches:
            cell, ids, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _unpack(batch.column(2), dim)
            heads, edges = ids.copy(), _bounds(cell)
            for s, e in zip(edges, edges[1:]):
                heads[s:e] = state.assign(cell[s], ids[s:e], x[s:e])
            # A head alone is no dense cell, and its row says nothing of a dense one.
            on = heads != ids
            yield pa.RecordBatch.from_arrays([pa.array(cell[on]), pa.array(ids[on]), pa.array(heads[on])], ["cell", "id", "head"])

    most = max(CROWD_ROWS, n * axes**depth * grids // CROWD_SHARE)
    crowded = heads.mapInArrow(quantised(True), "cell long").groupBy("cell").count().where(F.col("count") > most).select("cell", F.ceil(F.col("count") / most).alias("blocks"))
    cells = heads.mapInArrow(quantised(False), "cell long, id long, v binary").join(F.broadcast(crowded), "cell", "left")
    own, blocks = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))), F.coalesce("blocks", F.lit(1))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.shiftleft("cell", 30) + F.shiftleft(F.least(own, other), 15) + F.greatest(own, other))
    cells = cells.select(F.explode(pairs).alias("cell"), "id", "v")
    rows = cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(checked, "cell long, id long, head long")
    # Dense cells are named by their heads; (id, head) says that the vector lies in them. Cells that share a vector are adjacent.
    inside = rows.groupBy("id").agg(F.collect_set("head").alias("heads")).select("id", "heads", F.array_min("heads").alias("least"))
    adjacent = inside.select(F.explode(F.array_append("heads", F.col("id"))).alias("a"), F.col("least").alias("b")).where("a <> b")
    return least_labels(adjacent)


def described(groups: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, dim: int = 192, typical: int = 5) -> DataFrame:
    """(group_id, size, typical): each group's number of vectors and those nearest to its centre (the mean of its vectors at length one), nearest first, then by id.

    Sums are combined within tasks before they move, and so are the nearest; a group that holds a large share of the rows is in no single task whole.
    """
    once = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("vector_id"), F.col(vector_col).cast("array<double>").alias("v"))
    once = once.groupBy("vector_id").agg(F.first("v").alias("v"))
    rows = settle(groups.select("vector_id", "group_id").join(once, "vector_id"))
    centres = group_means(rows, "group_id", "v", dim).select("group_id", F.col("n").alias("size"), "centroid")
    near = Window.partitionBy("group_id").orderBy(F.desc("like"), "vector_id")
    liked = rows.join(centres.select("group_id", "centroid"), "group_id").select("group_id", "vector_id", cosine(F.col("v"), F.col("centroid")).alias("like"))
    some = liked.withColumn("r", F.row_number().over(near)).where(F.col("r") <= typical).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("r", "vector_id"))).alias("l"))
    return centres.select("group_id", "size").join(some, "group_id", "left").select("group_id", "size", F.transform("l", lambda x: x["vector_id"]).alias("typical"))


def densest(groups: DataFrame, members: int = 5) -> DataFrame:
    """(group_id, size, cells, dense, members): each group's size, in how many cells of the thinning grid it lies, the vectors in the densest of them (the least cell of equal ones) and the first of these."""
    cells = groups.groupBy("group_id", "cell").agg(F.count("*").alias("n"))
    best = cells.groupBy("group_id").agg(F.sum("n").alias("size"), F.count("*").alias("cells"), F.max(F.struct("n", (-F.col("cell")).alias("c"))).alias("b"))
    best = best.select("group_id", "size", "cells", F.col("b.n").alias("dense"), (-F.col("b.c")).alias("cell"))
    first = Window.partitionBy("group_id", "cell").orderBy("vector_id")
    some = groups.withColumn("r", F.row_number().over(first)).where(F.col("r") <= members)
    some = some.groupBy("group_id", "cell").agg(F.array_sort(F.collect_list("vector_id")).alias("members"))
    return best.join(some, ["group_id", "cell"]).drop("cell")
