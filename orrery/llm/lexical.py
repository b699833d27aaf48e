"""Ranked lexical search: an inverted index by shards of documents, read document by document through a heap of cursors.

`build_index` turns every partition of the documents into shards of about `SHARD` octets of text. A shard's documents are numbered by
ascending doc_id (nulls last). Each of its terms is a row with its postings: gaps between document numbers and term frequencies, both as
variable-length octets. One more row, without a term, holds the shard's doc_ids and lengths. Texts never travel.

`search` gives every shard the postings of the terms asked for, in blocks of about `BLOCK` queries. A task merges an item's postings
document by document: a heap holds the next document of each list, a second heap of bounded size the best documents so far, the lowest score
first and, among equal scores, the largest doc_id first. Lists whose highest scores together can't pass the lowest of a full heap leave the
merge and are only looked up for documents that can still pass; nothing that could rank is left out. The shards' best are ranked together.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. Scores are whole numbers:
w * ((10^9 tf) div (1000 tf + 8 m)) summed over an item's terms, once each, where m = 10 + ((90 n N) div L), w = floor(1000 ln((2N+2)/(2df+1))),
N counts the documents with a term, L their terms, n a document's terms.

Null and empty texts hold no term: such documents are never returned and such items have no rows. Every row of documents is a document and
every row of items an item, repeated rows and ids included; equal scores rank by doc_id, nulls last. Empty tables give empty results. Columns
other than doc_id and text, item_id and text are ignored. Texts of any length are indexed whole; a shard holds one text at least.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._shared import Staged, groups, partitions, slices, stage

#: Octets of text in a shard, about.
SHARD = 16 << 20
#: Queries that a shard answers in one task, about.
BLOCK = 100
#: Query terms up to so many rows are broadcast, with some 100 octets each.
BROADCAST_TERMS = 100_000

_OCTETS = np.arange(256)
_TERM = (_OCTETS >= 128) | np.isin(_OCTETS, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_LOWER = np.where((_OCTETS >= 65) & (_OCTETS <= 90), _OCTETS + 32, _OCTETS).astype(np.uint8)

_INDEX = "shard long, term string, n_docs long, docs binary, tfs binary"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a string array, one after another, and the number of the text each is from."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    borders = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    borders = borders - borders[0]
    inside = _TERM[octets]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = borders[:-1][borders[:-1] < borders[1:]]
    begins[first] = inside[first]  # texts that touch are not one term
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - starts)])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[octets[inside]]))
    return found, np.searchsorted(borders, starts, "right") - 1


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length octets of unsigned numbers, seven bits each, the lowest first; and where each number begins."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1 << (7 * k))
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, at


def unpacked(octets: bytes) -> np.ndarray:
    raw = np.frombuffer(octets, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(raw)]])))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins)


def _binary(octets: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(octets)]).cast(pa.binary())


def _shard(number: int, ids: list[pa.Array], texts: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    doc_ids = pa.concat_arrays(ids)
    known = ~np.asarray(doc_ids.is_null())
    values = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
    order = np.lexsort((values, ~known))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.cumsum([0] + [len(i) for i in ids])
    docs = rank[np.concatenate([d + first[i] for i, (_, d) in enumerate(texts)])]
    coded = pa.chunked_array([t for t, _ in texts]).dictionary_encode().unify_dictionaries()
    lengths = np.bincount(docs, minlength=len(order))
    about = np.packbits(known[order]).tobytes() + values[order].tobytes()
    yield pa.record_batch([pa.array([number]), pa.array([None], pa.string()), pa.array([len(order)]), pa.array([about], pa.binary()), pa.array([lengths.astype(np.int64).tobytes()], pa.binary())], ["shard", "term", "n_docs", "docs", "tfs"])
    if not len(docs):
        return
    words = coded.chunk(0).dictionary
    codes = np.concatenate([np.asarray(c.indices) for c in coded.chunks]).astype(np.int64)
    pairs, tf = np.unique(codes * len(order) + docs, return_counts=True)
    code, doc = pairs // len(order), pairs % len(order)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    (gap_octets, gap_at), (tf_octets, tf_at) = packed(gaps), packed(tf)
    borders = np.concatenate([starts, [len(code)]])
    table = [pa.array(np.full(len(starts), number)), words.take(pa.array(code[starts])).cast(pa.string()), pa.array(np.diff(borders)), _binary(gap_octets, gap_at[borders]), _binary(tf_octets, tf_at[borders])]
    rows = pa.record_batch(table, ["shard", "term", "n_docs", "docs", "tfs"])
    for at in range(0, rows.num_rows, 20_000):
        yield rows.slice(at, 20_000)


def build_index(docs: DataFrame) -> Staged:
    """The index of documents (doc_id, text) as a written table: shard, term, n_docs, docs, tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for part in slices(batches, 1):
            ids.append(part.column(0))
            texts.append(terms_of(part.column(1)))
            held += part.column(1).nbytes
            if held >= SHARD:
                yield from _shard(number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield from _shard(number, ids, texts)

    return Staged(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _INDEX), "lexical")


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found, at = terms_of(part.column(1))
            yield pa.record_batch([part.column(0).take(pa.array(at)), found.cast(pa.string())], ["item", "term"])

    return items.select("item", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item long, term string").distinct()


def best(lists: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k highest sums over lists of (ascending documents, their scores); equal sums by ascending document, sums above 0 only."""
    lists = sorted((x for x in lists if x[0]), key=lambda x: max(x[1]))
    docs, scores = [x[0] for x in lists], [x[1] for x in lists]
    bound, total = [], 0  # of the lists up to each one
    for s in scores:
        total += max(s)
        bound.append(total)
    n, first, least, kept = len(lists), 0, 0, []
    while first < n and bound[first] <= least:
        first += 1
    at = [0] * n
    heap = [docs[i][0] * n + i for i in range(first, n)]  # a document and its list in one number
    heapify(heap)
    while heap:
        doc, i = divmod(heap[0], n)
        score = 0
        while True:
            p = at[i]
            score += scores[i][p]
            p += 1
            at[i] = p
            if p < len(docs[i]):
                heapreplace(heap, docs[i][p] * n + i)
            else:
                heappop(heap)
                if not heap:
                    break
            other, i = divmod(heap[0], n)
            if other != doc:
                break
        for j in range(first - 1, -1, -1):
            if score + bound[j] <= least:
                break
            p = at[j] = bisect_left(docs[j], doc, at[j])
            if p < len(docs[j]) and docs[j][p] == doc:
                score += scores[j][p]
        if score <= least:
            continue
        if len(kept) < k:
            heappush(kept, (score, -doc))
        else:
            heapreplace(kept, (score, -doc))
        if len(kept) == k and kept[0][0] > least:
            least, before = kept[0][0], first
            while first < n and bound[first] <= least:
                first += 1
            if first > before:
                heap = [x for x in heap if x % n >= first]
                heapify(heap)
    return [(s, -d) for s, d in sorted(kept, reverse=True)]


def _answer(k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            about = table.filter(pa.compute.is_null(table["term"]))
            size = about["n_docs"][0].as_py()
            raw = about["docs"][0].as_py()
            skip = -(-size // 8)
            known = np.unpackbits(np.frombuffer(raw[:skip], np.uint8))[:size]
            ids = np.frombuffer(raw[skip:], np.int64)
            pull = 8 * (10 + (90 * np.frombuffer(about["tfs"][0].as_py(), np.int64) * n_docs) // max(n_terms, 1))
            held: dict[int, list] = {}
            asked = table.filter(pa.compute.is_valid(table["term"]))
            for w, gaps, tfs, items in zip(asked["w"].to_pylist(), asked["docs"].to_pylist(), asked["tfs"].to_pylist(), asked["items"].to_pylist()):
                doc, tf = np.cumsum(unpacked(gaps)), unpacked(tfs)
                entry = doc.tolist(), (w * ((1_000_000_000 * tf) // (1000 * tf + pull[doc]))).tolist()
                for item in items:
                    held.setdefault(item, []).append(entry)
            found = [(item, int(ids[d]) if known[d] else None, s) for item, lists in held.items() for s, d in best(lists, k)]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["item", "doc_id", "score"])

    return run


def search(index: Staged, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    spark = items.sparkSession
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    blocks = max(1, -(-numbered.count() // BLOCK))
    asked = stage(_item_terms(numbered).groupBy("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items")), "asked")
    rows = index.df.where("term IS NULL")
    totals = rows.mapInArrow(_totals, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    words = asked.select("term").distinct()
    near = F.broadcast if words.count() <= BROADCAST_TERMS else lambda x: x
    met = stage(index.df.where("term IS NOT NULL").join(near(words), "term"), "met")
    weight = F.floor(1000 * F.log((F.lit(2 * totals["docs"] + 2).cast("double") / (2 * F.sum("n_docs") + 1).cast("double"))))
    weighed = asked.join(met.groupBy("term").agg(weight.cast("long").alias("w")), "term")
    place = F.concat_ws(":", "shard", "block").alias("place")
    postings = met.join(weighed, "term").select(place, "term", "w", "items", "n_docs", "docs", "tfs")
    shards = rows.select("shard", "n_docs", "docs", "tfs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    shards = shards.select(place, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("w"), F.array().cast("array<long>").alias("items"), "n_docs", "docs", "tfs")
    dealt = postings.unionByName(shards).repartition(max(partitions(spark, index.octets()), rows.count() * blocks), "place").sortWithinPartitions("place")
    found = dealt.mapInArrow(_answer(k, totals["docs"], totals["terms"]), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term and their terms, of the shards of each batch."""
    for batch in batches:
        counts = [np.frombuffer(x, np.int64) for x in batch.column(batch.schema.get_field_index("tfs")).to_pylist()]
        yield pa.record_batch([pa.array([sum(int((c > 0).sum()) for c in counts)]), pa.array([sum(int(c.sum()) for c in counts)])], ["docs", "terms"])
