"""Approximate nearest neighbours by inner product, over an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. A query walks the pairs by summed distance, minus the inner
products of its halves with the centroids, with a heap, until the cells it has met hold as many rows as are wanted. The rows of those
cells are ranked by the exact inner product, in double precision on the original vectors.

How many rows are wanted is measured on the table at hand, whatever its size: for about `trial` of the queries, hash-chosen, all rows are ranked, and as many
rows are wanted as these queries must meet to find a share of `recall` of their true neighbours. So evenly spread vectors, which no index can prune, cost
most of a scan, and clustered ones little.

Centroids are fitted on a hash-chosen sample of about `sample` rows; every row is indexed. The number of centroids follows the number
of rows, so that a cell holds some dozens of them, up to 2048 a half. Neighbouring cells lie together in places of about `block` rows; larger cells are split by hash. A query goes
once to each place that holds cells of its walk, and says which; queries beyond `crowd` are dealt to several copies of each place. A task
holds the rows of one place at a time, queries pass by.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part. Rows that repeat vec_id and vector count once; different
vectors of one vec_id are candidates each. Ties go to the smaller vec_id. Fewer candidates than k: all. Empty tables give empty results. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from orrery.llm._shared import Staged, partitions

SAMPLE, RECALL, TRIAL, BLOCK, CROWD = 20_000, 0.95, 128, 8192, 200_000
MOST_CENTROIDS = 2048


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice; empty ones keep their place."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _chosen(rows: DataFrame, of: int, wanted: int, seed: int) -> np.ndarray:
    """The vectors of about `wanted` of so many rows, by a hash of vec_id."""
    share = int(min(1.0, wanted / max(1, of)) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(share)).select("vec_id", "embedding").limit(2 * wanted).toArrow()
    if not some.num_rows:
        some = rows.select("vec_id", "embedding").limit(min(of, wanted)).toArrow()
    return some.column("vec_id").to_numpy(), np.array(some.column("embedding").to_pylist(), np.float64).reshape(some.num_rows, -1)


def fit(vectors: DataFrame, rows: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the two halves."""
    k = int(min(MOST_CENTROIDS, max(2, (rows / 48) ** 0.5)))
    points = _chosen(vectors, rows, max(sample, 16 * k), 1)[1]
    half = points.shape[1] // 2
    return kmeans(points[:, :half], k), kmeans(points[:, half:], k)


def usable(embedding: str = "embedding") -> Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold the rows wanted. left, right: distances to the centroids of each half."""
    a, b, k = np.argsort(left, kind="stable"), np.argsort(right, kind="stable"), len(right)
    open_, cells, held, deep = [(left[a[0]] + right[b[0]], 0, 0)], [], 0, [-1] * (len(a) + 1)
    while open_ and held < wanted:
        _, i, j = heapq.heappop(open_)
        deep[i] = j
        cell = int(a[i]) * k + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        # A pair opens once the pairs before it in its row and its column are done.
        if i + 1 < len(a) and deep[i + 1] == j - 1:
            heapq.heappush(open_, (left[a[i + 1]] + right[b[j]], i + 1, j))
        if j + 1 < k and (i == 0 or deep[i - 1] >= j + 1):
            heapq.heappush(open_, (left[a[i]] + right[b[j + 1]], i, j + 1))
    return cells


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of equal length as a matrix of doubles."""
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed in the order of the components, so that equal vectors have equal scores everywhere."""
    out = np.zeros(len(q))
    for k in range(queries.shape[1]):
        out += queries[q, k] * rows[r, k]
    return out


def top(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, score) of each query's k best rows but its own; open_: which rows a query may meet."""
    scores = queries @ rows.T
    scores[ids[:, None] == own[None, :]] = -np.inf
    if open_ is not None:
        scores[~open_] = -np.inf
    at = np.isfinite(scores)
    if scores.shape[1] > k:  # a fast product finds who may be among the k best, with room for its rounding; the exact one decides
        room = 1e-12 * queries.shape[1] * np.linalg.norm(queries, axis=1) * (np.linalg.norm(rows, axis=1).max() if len(rows) else 0)
        at &= scores >= (np.partition(scores, -k, axis=1)[:, -k] - room)[:, None]
    q, r = np.nonzero(at)
    s = exact(queries, rows, q, r)
    order = np.lexsort((own[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    keep = _place(q) < k
    return q[keep], r[keep], s[keep]


def _place(q: np.ndarray) -> np.ndarray:
    """How many equal values stand before each in a sorted array."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))


def best_of(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """The k best of each query among (query, row, score) arrays, as one piece, and their number."""
    if not held:
        return [], 0
    q, v, s = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = _place(q) < k
    return [(q[keep], v[keep], s[keep])], int(keep.sum())


def _ranked(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    q, v, s = held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])


def _single(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows, repeated ones once."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.array(sorted({(i, v.tobytes()): at for at, (i, v) in enumerate(zip(ids.tolist(), x, strict=True))}.values()), np.int64)


def wanted_rows(indexed: DataFrame, left: np.ndarray, right: np.ndarray, counts: np.ndarray, queries: int, k: int, recall: float = RECALL, trial: int = TRIAL) -> int:
    """How many rows the walks of a trial of the queries must meet to find that share of their true neighbours, which a pass over all rows tells."""
    ids, x = _chosen(indexed.where("asks"), queries, trial, 2)
    if not len(ids):
        return 0
    width, spark = x.shape[1], indexed.sparkSession
    shared = spark.sparkContext.broadcast((ids, x))

    def scan(batches):
        ids, x = shared.value
        held, rows = [], 0
        cells = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            q, r, s = top(ids, x, own, matrix(batch.column(1), width), k)
            held.append((q, own[r] if len(r) else own[:0], s))
            cells |= zip(held[-1][1].tolist(), batch.column(2).to_numpy()[r].tolist(), strict=True)
            rows += len(q)
            if rows > 100_000:
                held, rows = best_of(held, k)
                alive = set(held[0][1].tolist())
                cells = {v: c for v, c in cells.items() if v in alive}
        q, v, s = best_of(held, k)[0][0] if held else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array([cells[i] for i in v.tolist()], pa.int64())], ["q", "vec_id", "score", "cell"])

    found = indexed.select("vec_id", "embedding", "cell").mapInArrow(scan, "q long, vec_id long, score double, cell long")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("q", "cell").toArrow()
    met, half = [], left.shape[1]
    answers = np.stack([best.column("q").to_numpy(), best.column("cell").to_numpy()])
    for q in np.unique(answers[0]).tolist():
        far = (-(left @ x[q, :half])[:, None] - (right @ x[q, half:])[None, :]).ravel()
        own = far[answers[1][answers[0] == q]]
        edges = np.unique(own)
        before = np.cumsum(np.bincount(np.searchsorted(edges, far, "left"), weights=counts, minlength=len(edges) + 1))
        met.append(before[np.searchsorted(edges, own, "left")])
    met = np.sort(np.concatenate(met)) if met else np.zeros(1)
    return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))))])


def search(table: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, trial: int = TRIAL, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on table's rows."""
    spark = table.sparkSession
    kind = "float" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = table.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null")
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0]["w"]
    rows = rows.where(F.size("embedding") == width)
    left, right = fit(rows, widths[0]["count"], sample)
    half = left.shape[1]
    shared = spark.sparkContext.broadcast((left, right))

    def index(batches):
        left, right = shared.value
        for batch in batches:
            x = matrix(batch.column(1), width)
            a = np.argmax(x[:, :half] @ left.T - 0.5 * (left**2).sum(1), axis=1)
            b = np.argmax(x[:, half:] @ right.T - 0.5 * (right**2).sum(1), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a * len(right) + b, pa.int64())], ["vec_id", "embedding", "asks", "cell"])

    written = Staged(rows.mapInArrow(index, f"vec_id long, embedding array<{kind}>, asks boolean, cell long"), "indexed")
    indexed = written.df
    counted = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).toArrow()
    counts = np.zeros(len(left) * len(right), np.int64)  # at most 2048 x 2048 cells
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    queries = int(counted.column("asks").to_numpy().sum())
    wanted = max(k + 1, wanted_rows(indexed, left, right, counts, queries, k, recall, trial))
    # Cells that begin in one stretch of `block` rows share a place; a cell of more has places of its own.
    base, parts = (np.cumsum(counts) - counts) // block, np.maximum(1, -(-counts // block))
    base[parts > 1] = len(counts) + np.flatnonzero(parts > 1)
    copies = max(1, -(-queries // crowd))
    known = spark.sparkContext.broadcast((counts, base, parts))

    def place(base: np.ndarray, part: np.ndarray, copy: np.ndarray) -> np.ndarray:
        return (base * (1 << 20) + part) * copies + copy

    def ask(batches):
        left, right = shared.value
        counts, base, parts = known.value
        for batch in batches:
            x, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
            a, b = -(x[:, :half] @ left.T), -(x[:, half:] @ right.T)
            for i in range(len(x)):
                cells = np.array(walk(a[i], b[i], counts, wanted), np.int64)
                cells = cells[np.argsort(base[cells], kind="stable")]
                begin = np.flatnonzero(np.r_[True, np.diff(base[cells]) != 0])
                places, lists = [], []
                for own in np.split(cells, begin[1:]):
                    for part in range(parts[own[0]]):
                        places.append(int(place(base[own[0]], part, int(ids[i]) % copies)))
                        lists.append(own.tolist())
                at = pa.array(np.full(len(places), i))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([True] * len(places)), batch.column(0).take(at), batch.column(1).take(at), pa.array(lists, pa.list_(pa.int64()))], _NAMES)

    def lie(batches):
        _, base, parts = known.value
        for batch in batches:
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for copy in range(copies):
                at = place(base[cells], (ids ^ ids >> 17) % parts[cells], copy)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([False] * len(at)), batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(cells))], _NAMES)

    shape = f"place long, asks boolean, vec_id long, embedding array<{kind}>, cells array<long>"
    asked = indexed.where("asks").select("vec_id", "embedding").mapInArrow(ask, shape)
    data = indexed.select("vec_id", "embedding", "cell").mapInArrow(lie, shape)

    def rank(batches):
        held, many = [], 0
        for own, x, cells, ids, q, lists in _met(batches, width):
            codes, local = np.unique(cells, return_inverse=True)
            asked = np.zeros((len(ids), len(codes)), bool)
            for i, some in enumerate(lists):
                at = np.searchsorted(codes, some)
                at = at[at < len(codes)]
                asked[i, at] = np.isin(codes[at], some)
            a, b, s = top(ids, q, own, x, k, None if asked.all() else asked[:, local])
            held.append((ids[a], own[b], s))
            many += len(a)
            if many > 200_000:
                held, many = best_of(held, k)
                if many > 100_000:  # many queries: pass on what there is
                    yield _ranked(held)
                    held, many = [], 0
        yield _ranked(best_of(held, k)[0])

    met = asked.unionByName(data).repartition(partitions(spark, written.octets() * 4), "place").sortWithinPartitions("place", "asks", "vec_id")
    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_NAMES = ["place", "asks", "vec_id", "embedding", "cells"]


def _met(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(ids, vectors and cells of a place's rows; ids, vectors and lists of cells of some of its queries). Rows of a place stand before its queries."""
    at, rows, found, last = None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        places, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(places) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(places)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if places[a] != at:
                at, rows, found, last = places[a], [], None, None
            if not asks[a]:
                rows.append(part)
                continue
            if found is None and rows:
                whole = pa.Table.from_batches(rows)
                ids, x, cells = whole.column(2).to_numpy(), matrix(whole.column(3), width), whole.column(4).combine_chunks().flatten().to_numpy()
                keep = _single(ids, x)
                found, rows = (ids[keep], x[keep], cells[keep]), []
            if found is None:
                continue
            ids, q, lists = part.column(2).to_numpy(), matrix(part.column(3), width), part.column(4)
            keep = _single(ids, q)
            if last is not None and len(keep) and ids[keep[0]] == last[0] and q[keep[0]].tobytes() == last[1]:
                keep = keep[1:]  # a repeated query, over two batches
            last = (ids[-1], q[-1].tobytes())
            for lo in range(0, len(keep), 256):
                some = keep[lo : lo + 256]
                yield (*found, ids[some], q[some], [lists[int(i)].values.to_numpy() for i in some])
