"""Near copies: all pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and their components.

SimHash fingerprints of the sets are searched by BK-trees (simhash.links), and what they link is confirmed on the whole sets. As a similarity of 0.8 leaves some ten bits
different, which no radius of use reaches, a second search completes the first: under one order of all shingles, common ones last, two sets of n and m
shingles at that similarity share one of the first n - ceil(0.8 n) + 1 of the one and of the first m - ceil(0.8 m) + 1 of the other, so pairs are
formed only within groups of sets that share such a shingle, where sizes and places leave 0.8 possible, and each is confirmed too. The order takes its counts from a
hash-chosen sixteenth of the rows; any order is right, this one keeps groups small. Equal sets are one node. Fingerprints come first, then the pairs with the four least
nodes of each group (nodes are hashes, so near copies meet in the same few wherever they meet), then those with the next ones up to 32 and 128 (`LEADERS`), then all others; each pass takes only groups that have more, and forms no pair that the
ones before it have compared or connected, so a group of n copies costs some n pairs, not their square. A bit for each shingle, in a bitmap of some times as many bits, bounds what two sets can have in
common from above; only pairs that it leaves possible are compared, on the whole sets of their nodes. A node's set is made once, from its text, when it first stands in such a pair.

Shingles are of lower-cased words (ASCII) between white space; a text of fewer than 5 words is one shingle. Null and empty texts have equal, empty
sets. Shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import Staged, bitmap, marked_in, partitions, slices, stage, utf8
from orrery.llm.simhash import components, fingerprint_of, links

WIDTH = 5
#: Least nodes of a group with which its others are compared, pass after pass, before all are.
LEADERS = (4, 32, 128)
#: Bits of the bitmap by which pairs are ruled out where they would be formed.
MARK = 512
#: Counted common shingles at most; rarer ones come first in the order.
COMMON = 200_000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """key and the set of every row of key and text (bytes)."""

    def of(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t) for t in batch.column(1).to_pylist()])], [key, "set"])

    return rows.select(key, "text").mapInArrow(of, f"{key} long, set array<long>")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met in two or more of a sixteenth of the rows, in order, and their counts."""
    some = _sets(rows.where(F.pmod(F.xxhash64("row"), F.lit(16)) == 0), "row").select(F.explode("set").alias("key"))
    met = some.groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys, counts = met.column("key").to_numpy(), met.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def bits_of(found: np.ndarray) -> bytes:
    """A bitmap of a set: as many bits as a power of two, four for each shingle at least."""
    size = max(64, 1 << max(0, 4 * len(found) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[found.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def mark_of(found: np.ndarray) -> bytes:
    """A bitmap of `MARK` bits, whatever the set."""
    out = np.zeros(MARK, np.uint8)
    out[found.view(np.uint64) & np.uint64(MARK - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def possible(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of n and m shingles with these bitmaps may have a similarity of 0.8: each bit of one that the other lacks is a shingle that it lacks."""
    while len(a) > len(b):
        a = _folded(a)
    while len(b) > len(a):
        b = _folded(b)
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    return 9 * min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count()) >= 4 * (n + m)


def _folded(bits: bytes) -> bytes:
    """The bitmap of the same set with half the bits."""
    half = len(bits) // 2
    return (int.from_bytes(bits[:half], "little") | int.from_bytes(bits[half:], "little")).to_bytes(half, "little")


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, node, n, the fingerprint, the bitmap, and the shingles of which similar sets share one."""
    keys, counts = common

    def of(batches):
        for batch in slices(batches, 1):
            nodes, sizes, prints, bits, marks, heads = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n = len(found)
                nodes.append(_node(found))
                sizes.append(n)
                prints.append(fingerprint_of(found))
                bits.append(bits_of(found))
                marks.append(mark_of(found))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    found = found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]
                heads.append(found[: n - (4 * n + 4) // 5 + 1])
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs[0], pa.array(sizes, pa.int64()), longs[1], pa.array(bits, pa.binary()), pa.array(marks, pa.binary()), _lists(heads)], ["row", "node", "n", "fp", "bits", "mark", "head"])

    return rows.mapInArrow(of, "row long, node long, n long, fp long, bits binary, mark binary, head array<long>")


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (key, node, n, pos) whose key is not alone, with the number of those of the key."""

    def of(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key = now.column("key").to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            yield from _repeated(now.slice(0, cut), key[:cut])
            held = now.slice(cut)
        if held is not None:
            yield from _repeated(held, held.column("key").to_numpy())

    def _repeated(part, key):
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        yield from part.append_column("size", pa.array(size)).filter(pa.array(size > 1)).combine_chunks().to_batches()

    return postings.mapInArrow(of, "key long, node long, n long, pos int, size long")


def _met(part: dict[str, np.ndarray], old: int, first: int, last: int | None):
    """Pairs of node numbers that may be similar and have different labels, of the members first to last (exclusive) of each run of keys with those after them. The first `old` rows have met each other."""
    key = part["key"]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(starts[1:], len(key))
    longest = int((ends - starts).max(initial=0))
    n, pos, label, mark, node = (part[c] for c in ("n", "pos", "label", "mark", "node"))
    for i in range(first, min(last, longest) if last else longest):
        runs = np.flatnonzero(ends - starts > i + 1)
        if not len(runs):
            return
        left = starts[runs] + i
        after = np.maximum(left + 1, old)  # rows at hand before have met
        count = np.maximum(0, ends[runs] - after)
        a = np.repeat(left, count)
        b = np.repeat(after - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        # 9 * overlap >= 4 * (n + m) is a similarity of 0.8; the pair's first common shingle leaves what follows it in both.
        keep = (label[a] != label[b]) & (9 * (1 + np.minimum(n[a] - pos[a] - 1, n[b] - pos[b] - 1)) >= 4 * (n[a] + n[b]))
        a, b = a[keep], b[keep]
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            lacks, lacked = np.bitwise_count(mark[x] & ~mark[y]).sum(1, dtype=np.int64), np.bitwise_count(mark[y] & ~mark[x]).sum(1, dtype=np.int64)
            may = 9 * np.minimum(n[x] - lacks, n[y] - lacked) >= 4 * (n[x] + n[y])
            if may.any():
                yield node[x[may]], node[y[may]]


def _pairs(shared: DataFrame, tasks: int, first: int, last: int | None) -> DataFrame:
    """Pairs (a, b) of nodes of a group that may be similar and have different labels: the members first to last of each with those after them.

    Groups come sorted, and of one that goes on in the next batch only the members that still meet others are kept.
    """
    columns = ("key", "node", "n", "pos", "label")

    def of(batches):
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns}
            new["mark"] = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("mark")).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            old = 0 if held is None else len(held["key"])
            if held is not None and held["key"][0] != new["key"][0]:
                held, old = None, 0
            part = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            for a, b in _met(part, old, first, last):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            begins = int(np.searchsorted(part["key"], part["key"][-1]))
            held = {c: v[begins : begins + last if last else None].copy() for c, v in part.items()}

    dealt = shared.repartition(tasks, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(of, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    return both.where(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def _possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that the bitmaps leave possible. marks: node, n, bits, one row for each node."""

    def of(batches):
        for batch in batches:
            a, b, n, x, m, y = (batch.column(i) for i in range(6))
            keep = [possible(*z) for z in zip(n.to_pylist(), x.to_pylist(), m.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: marks.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"x_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "x_a", "n_b", "x_b")
    return both.mapInArrow(of, "a long, b long")


def _named(rows: DataFrame, nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """node and set of the nodes, each from its least row; rows are picked by a bitmap, so texts are not shuffled. Some other nodes may come as well."""
    least = marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(stage(least.select(F.xxhash64("row").alias("h")), "least")))

    def some(batches):
        for batch in slices(batches, 1):
            own = batch.filter(pa.array(marked_in(bits.value, batch.column(0).to_numpy().view(np.uint64))))
            sets = [shingles(t) for t in own.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in sets], np.uint64).view(np.int64)), _lists(sets)], ["node", "set"])

    return rows.select(F.xxhash64("row").alias("h"), "text").mapInArrow(some, "node long, set array<long>")


def near_copies(docs: DataFrame) -> DataFrame:
    """row and root, equal for the rows of a component, for docs of row (distinct longs) and text; docs should be a written table."""
    spark, rows = docs.sparkSession, docs.select("row", utf8("text").alias("text"))
    written = Staged(_prefixes(rows, _common(rows)), "prefixes")
    marked, tasks, passing = written.df, partitions(spark, written.octets()), []

    def kept(df: DataFrame, label: str) -> DataFrame:
        passing.append(Staged(df, label))
        return passing[-1].df

    one = marked.groupBy("node").agg(F.min_by(F.struct("n", "head"), "row").alias("x")).select("node", "x.*")
    postings = one.select("node", "n", F.posexplode("head").alias("pos", "key")).select("key", "node", "n", "pos").repartition(tasks, "key").sortWithinPartitions("key")
    marks = kept(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("mark").alias("mark")), "bitmaps")
    shared = kept(_shared(postings).join(marks.select("node", "mark"), "node"), "shared")
    # Fingerprints link their least nodes, and each of them the other nodes that have it.
    prints = kept(marked.select("fp", "node").distinct(), "fingerprints")
    least = kept(prints.groupBy("fp").agg(F.min("node").alias("m")), "nodes")
    near = kept(links(least.select("fp")), "near")
    of = lambda side: least.select(F.col("fp").alias(side), F.col("m").alias(f"m_{side}"))
    simhash = near.join(of("a"), "a").join(of("b"), "b").select(F.least("m_a", "m_b").alias("a"), F.greatest("m_a", "m_b").alias("b"))
    simhash = simhash.unionByName(prints.join(least, "fp").where("m < node").select(F.col("m").alias("a"), F.col("node").alias("b")))

    sets, roots, largest = None, spark.createDataFrame([], "node long, root long"), shared.agg(F.max("size")).first()[0] or 0
    for first, last in ((None, None), *zip((0, *LEADERS), (*LEADERS, None))):
        if first is None:
            pairs = simhash
        elif first + 1 >= largest:  # no group has more
            break
        else:
            named = shared.where(F.col("size") > first + 1).join(roots, "node", "left").select("key", "node", "n", "pos", "mark", F.coalesce("root", "node").alias("label"))
            pairs = _pairs(named, tasks, first, last)
        pairs = kept(_possible(pairs.distinct(), marks), "pairs")
        if pairs.isEmpty():
            continue
        new = _ends(pairs) if sets is None else _ends(pairs).join(sets.select("node"), "node", "left_anti")
        new = kept(new, "ends")
        if not new.isEmpty():
            made = kept(_named(rows, new, marked.select("row", "node")), "sets")
            sets = made if sets is None else sets.unionByName(made)
        confirmed = kept(_confirmed(pairs, sets).distinct(), "links")
        if confirmed.isEmpty():
            continue
        # A node's root stands for the links that led to it.
        roots = stage(components(confirmed.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    for table in passing:
        table.drop()
    return marked.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def without(docs: DataFrame, gone: DataFrame, row: str = "row") -> DataFrame:
    """docs without the rows in the written table gone (of that column). Rows that a bitmap clears are not shuffled; the others meet gone."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64(row).alias("h"))))
    hashed = docs.withColumn("__or_h", F.xxhash64(row))

    def which(clear: bool):
        def of(batches):
            for batch in batches:
                there = marked_in(bits.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(~there if clear else there))

        return hashed.mapInArrow(of, hashed.schema).drop("__or_h")

    return which(True).unionByName(which(False).join(gone.select(row), row, "left_anti").select(*docs.columns))
