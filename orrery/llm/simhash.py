"""Near-duplicates by SimHash: fingerprints, BK-trees within shards, connected components.

Fingerprints of whole texts that differ in at most `radius` bits link. Distinct fingerprints are dealt to
shards by agreeing bit blocks (of B blocks, linked fingerprints agree on B - radius at least), so every linked
pair meets in a shard. A shard holds BK-trees, whose children are keyed by the integer Hamming distance to
the parent; a search follows only edges within the radius. A shard with more than `tree_limit` members is split again
by its unused bits, which loses no pair. Trees reach the fingerprints that query them through the shuffle of the
shard keys; a Spark broadcast would grow with the corpus. Shards emit links to one member of each local
component, at most one a fingerprint, and components are joined by the tasks that read them, then by the alternating large-star and small-star rounds.

Null texts count as empty and have fingerprint zero. Repeated rows and rows with a null doc_id keep a row each; a
component's id is the smallest non-null doc_id in it (null if it has none). Empty tables give empty results. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import Staged, groups, partitions, slices, stage, utf8

RADIUS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, each shingle counted as often as it occurs."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    return fingerprint_of(np.array(hashes, dtype="<u8"))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes; 0 of none."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def of(batches):
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(of, "doc_id long, fp long")


class BKTree:
    """A tree over integers; a child hangs on its parent by their Hamming distance."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.values, self.children = radius, [], []

    def near(self, value: int) -> list[int]:
        """Places of the members within the radius."""
        if not self.values:
            return []
        found, open_, r = [], [0], self.radius
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= r:
                found.append(at)
            below = self.children[at]
            if below:
                open_ += [below[k] for k in range(max(d - r, 1), d + r + 1) if k in below]
        return found

    def add(self, value: int) -> int:
        """The value's place; equal values share one."""
        place, at = len(self.values), 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = place
                break
            at = nxt
        self.values.append(value)
        self.children.append({})
        return place


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _unite(members: list[int], free: list[int], parent: dict[int, int], radius: int, tree_limit: int) -> None:
    """Unites all members within the radius. free: bit positions on which the members may still differ."""
    if len(members) > tree_limit and len(free) > 8 * (radius + 1):
        size = -(-len(free) // (radius + 1))
        for k in range(radius + 1):  # of radius + 1 blocks, linked members agree on one
            block = free[k * size : (k + 1) * size]
            mask = sum(1 << b for b in block)
            parts: dict[int, list[int]] = {}
            for v in members:
                parts.setdefault(v & mask, []).append(v)
            rest = [b for b in free if b not in set(block)]
            for part in parts.values():
                if len(part) > 1:
                    _unite(part, rest, parent, radius, tree_limit)
        return
    tree = BKTree(radius)
    for v in members:
        for at in tree.near(v):
            a, b = _find(parent, tree.values[at]), _find(parent, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)


def _blocks(n: int, radius: int) -> int:
    """Into how many blocks to cut 64 bits so that a shard holds some dozens of n evenly spread fingerprints."""
    b = radius + 1
    while b < radius + 4 and n > 64 << (64 // b) * (b - radius):
        b += 1
    return b


def links(distinct: DataFrame, radius: int = RADIUS, tree_limit: int = 2048) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp, with the components of the full link graph."""
    spark = distinct.sparkSession
    count = _blocks(distinct.count(), radius)
    edges = [64 * k // count for k in range(count + 1)]
    chosen = list(combinations(range(count), count - radius))
    masks = [sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in c) for c in chosen]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("block", "part"))
    keyed = keyed.select("fp", "block", F.xxhash64("block", "part").alias("shard"), "part")

    def search(batches):
        a, b = [], []
        for group in groups(batches, "shard"):
            if group.num_rows < 2:
                continue
            rows = {}
            for fp, block, part in zip(*(group.column(c).to_pylist() for c in ("fp", "block", "part")), strict=True):
                rows.setdefault((block, part), []).append(fp & 0xFFFFFFFFFFFFFFFF)
            for (block, _), members in rows.items():
                if len(members) > 1:
                    parent = {v: v for v in members}
                    _unite(sorted(members), [i for i in range(64) if not masks[block] >> i & 1], parent, radius, tree_limit)
                    for v in members:
                        if (root := _find(parent, v)) != v:
                            a.append(root)
                            b.append(v)
            if len(a) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    dealt = keyed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a long, b long").distinct()


#: Edges that are joined at once, and the octets of a written table that a task reads for it, about as many edges.
_EDGES, _EDGE_OCTETS = 1 << 18, 4 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _joined(edges: Staged) -> DataFrame:
    """Edges with the same components as those of the table (u, v): each task joins what it reads, a stretch of edges at a time."""

    def of(batches):
        held, count = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.num_rows
            if count and (batch is None or count >= _EDGES):
                found = stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])
                held, count = [], 0

    return edges.df.coalesce(max(1, -(-edges.octets() // _EDGE_OCTETS))).mapInArrow(of, "u long, v long")


def _rooted(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); the root is the smallest node of its component.

    Tasks join the edges that they read; what they leave apart goes through rounds of large-star and small-star, each a written table, until every node has
    an edge to its root and no other. Rounds join by shuffle and sort, as a broadcast a round would add up at the driver.
    """
    now = Staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        joined = Staged(_joined(now), "edges")
        now.drop()
        if _rooted(joined.df):
            break
        both = joined.df.unionByName(joined.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = Staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        joined.drop()
    return joined.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(joined.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    marked = stage(fingerprints(docs, width), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
