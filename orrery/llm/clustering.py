"""Centroid clustering with group bounds: k-means whose points skip the centroids that can't be nearest.

Vectors are scaled to whole numbers and packed into blocks of `BLOCK` rows, one block a row of a written table, so that a round is one pass
of numpy kernels without a shuffle. A block also holds each vector's centroid, an upper bound of the distance to it, and one lower bound for
each group of centroids; centroids are put into groups once, at the start. After the centroids have moved, bounds change by their drifts. A
vector whose upper bound is below all its lower bounds keeps its centroid (global filter). For the others the upper bound becomes exact; then groups
whose bound is not below it are left out (group filter), and only the centroids of the groups that remain are measured, in whole numbers. Bounds are
doubles that give way by a relative 10^-9, more than their rounding, so results are those of a full scan. Each pass writes the blocks again with
the sums of their clusters; the next centroids come from those columns alone, added up by Spark.

Distances are squared Euclidean in whole numbers; equal ones go to the smaller centroid number. The centroids start as the k vectors with the
smallest hash of their id, rows with equal hashes by their components. A round replaces every centroid that has vectors by their componentwise
floor(sum / count). Vectors that are null, have another number of components, or hold null or non-finite ones take no part and have no row. Null ids are
hashed as an empty text. Repeated rows and ids count each. With fewer than k vectors there are fewer centroids; empty tables give
empty results. Components beyond 2^27 in magnitude once scaled are an error, as squared distances would leave the long. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import Staged

#: Vectors in a block.
BLOCK = 4096
#: Centroids in a group, about.
GROUP = 4
_SLACK = 1e-9
_LIMIT = 1 << 27

_BLOCKS = "vec_ids binary, known binary, points binary, assigned binary, upper binary, lower binary, sums binary, measured long"


def kept(table: DataFrame, size: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & sound)


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(values * scale)
    if len(whole) and np.abs(whole).max() >= _LIMIT:
        raise ValueError("A scaled component of 2^27 or more: squared distances would leave the long.")
    return whole.astype(np.int64)


def starts(vectors: DataFrame, k: int, scale: int) -> np.ndarray:
    """The first centroids."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return _scaled(np.array([r["embedding"] for r in rows], np.float64), scale)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each centroid, by a few rounds of k-means over the centroids."""
    means = centroids[:: max(1, -(-len(centroids) // groups))][:groups].astype(np.float64)
    of = np.zeros(len(centroids), np.int64)
    for _ in range(5):
        of = ((centroids[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([centroids[of == g].mean(0) if (of == g).any() else means[g] for g in range(len(means))])
    return of


def nearest(points: np.ndarray, centroids: np.ndarray, group: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Puts every point at its nearest centroid, in place, given valid bounds; the number of distances measured."""
    groups = lower.shape[1]
    open_ = np.flatnonzero(upper >= lower.min(1))
    measured = 0
    if len(open_):
        own = ((points[open_] - centroids[assigned[open_]]) ** 2).sum(1)
        measured += len(open_)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        still = upper[open_] >= lower[open_].min(1)
        open_, own = open_[still], own[still]
    if not len(open_):
        return measured
    scan = upper[open_][:, None] >= lower[open_]
    best, least, held = assigned[open_].copy(), own.copy(), assigned[open_].copy()
    first = np.full((len(open_), groups), np.iinfo(np.int64).max)  # the least distance to a scanned group's centroids, and the next but one
    second = first.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero(scan[:, group[c]])
        if not len(rows):
            continue
        far = ((points[open_[rows]] - centroids[c]) ** 2).sum(1)
        measured += len(rows)
        g = group[c]
        second[rows, g] = np.minimum(second[rows, g], np.maximum(first[rows, g], far))
        first[rows, g] = np.minimum(first[rows, g], far)
        wins = (far < least[rows]) | ((far == least[rows]) & (c < best[rows]))
        best[rows[wins]], least[rows[wins]] = c, far[wins]
    root = lambda x: np.sqrt(x.astype(np.float64)) * (1 - _SLACK)
    bounds = lower[open_]
    for g in range(groups):
        rows = scan[:, g]
        inside = group[best] == g
        bounds[rows & ~inside, g] = root(first[rows & ~inside, g])
        bounds[rows & inside, g] = root(second[rows & inside, g])
        # The centroid left behind belongs to a group that was not scanned.
        left = ~rows & (group[held] == g) & (best != held)
        bounds[left, g] = np.minimum(bounds[left, g], root(own[left]))
    lower[open_], assigned[open_], upper[open_] = bounds, best, np.sqrt(least.astype(np.float64)) * (1 + _SLACK)
    return measured


def _packs(size: int, scale: int, groups: int):
    """Blocks of vectors whose bounds say nothing yet."""

    def block(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        n = len(points)
        known = ~np.asarray(ids.is_null())
        cells = [np.asarray(ids.fill_null(0)).astype(np.int64), known, points.astype(np.int32), np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, groups))]
        return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cells] + [pa.array([b""], pa.binary()), pa.array([0], pa.int64())], ["vec_ids", "known", "points", "assigned", "upper", "lower", "sums", "measured"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            points.append(_scaled(np.asarray(batch.column(1).flatten()).reshape(-1, size), scale))
            n += batch.num_rows
            while n >= BLOCK:
                held, rows = pa.concat_arrays(ids), np.concatenate(points)
                yield block(held.slice(0, BLOCK), rows[:BLOCK])
                ids, points, n = [held.slice(BLOCK)], [rows[BLOCK:]], n - BLOCK
        if n:
            yield block(pa.concat_arrays(ids), np.concatenate(points))

    return run


def _pass(size: int, groups: int, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None):
    """Assigns the vectors of each block; drift: how far each centroid has moved since the bounds were set."""
    k = len(centroids)
    far = np.array([drift[group == g].max(initial=0) for g in range(groups)]) if drift is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, raw, *state in zip(*(batch.column(i).to_pylist() for i in range(6))):
                points = np.frombuffer(raw, np.int32).reshape(-1, size).astype(np.int64)
                assigned = np.frombuffer(state[0], np.int32).astype(np.int64)
                upper, lower = np.frombuffer(state[1]).copy(), np.frombuffer(state[2]).reshape(-1, groups).copy()
                if drift is not None:
                    upper = (upper + drift[assigned]) * (1 + _SLACK)
                    lower = np.maximum(0, (lower - far) * (1 - _SLACK))
                measured = nearest(points, centroids, group, assigned, upper, lower)
                sums = np.zeros((k, size + 2), np.int64)
                for c in range(k):
                    mine = points[assigned == c]
                    sums[c, 0], sums[c, 1], sums[c, 2:] = len(mine), ((mine - centroids[c]) ** 2).sum(), mine.sum(0)
                cells = [ids, known, raw, assigned.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), sums.tobytes()]
                yield pa.record_batch([pa.array([c], pa.binary()) for c in cells] + [pa.array([measured], pa.int64())], ["vec_ids", "known", "points", "assigned", "upper", "lower", "sums", "measured"])

    return run


def _summed(blocks: DataFrame, k: int, size: int) -> list[list[int]]:
    """For each cluster: its count, the sum of its squared distances, and the sums of its components, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                cells = np.frombuffer(raw, np.int64)
                yield pa.record_batch([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "value"])

    rows = blocks.select("sums").mapInArrow(run, "cell int, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = [[0] * (size + 2) for _ in range(k)]
    for r in rows:
        out[r["cell"] // (size + 2)][r["cell"] % (size + 2)] = int(r["value"])
    return out


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    vectors = kept(table, size)
    centroids = starts(vectors, k, scale)
    k = len(centroids)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return table.sparkSession.createDataFrame([], empty)
    groups = max(1, -(-k // GROUP))
    group = grouped(centroids, groups)
    held, drift = Staged(vectors.mapInArrow(_packs(size, scale, groups), _BLOCKS), "blocks"), None
    for step in range(rounds + 1):
        before, held = held, Staged(held.df.mapInArrow(_pass(size, groups, centroids, group, drift), _BLOCKS), f"round{step}")
        before.drop()
        sums = _summed(held.df, k, size)
        if step == rounds:
            break
        moved = np.array([[s // row[0] for s in row[2:]] if row[0] else list(old) for row, old in zip(sums, centroids.tolist())], np.int64)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        centroids = moved
    inertia, whole = [row[1] for row in sums], sum(row[1] for row in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, raw, of in zip(*(batch.column(i).to_pylist() for i in range(4))):
                points, assigned = np.frombuffer(raw, np.int32).reshape(-1, size).astype(np.int64), np.frombuffer(of, np.int32)
                far = ((points - centroids[assigned]) ** 2).sum(1)
                columns = [pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool)), pa.array(assigned), pa.array(far), pa.array([inertia[c] for c in assigned], pa.int64()), pa.array([whole] * len(far), pa.int64()), pa.array([digests[c] for c in assigned])]
                yield pa.record_batch(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return held.df.select("vec_ids", "known", "points", "assigned").mapInArrow(unpack, empty)
