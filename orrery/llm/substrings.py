"""Exact substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words of a document. Its minimiser is the run of `inner` words in it with the smallest hash, the leftmost
if equal; consecutive windows that share one minimiser travel as one packed string to the bucket of that minimiser, where
windows are sorted and counted exactly. Equal windows have equal minimisers, so they meet in one bucket.

First, the occurrences of every minimiser are counted. Windows whose minimiser occurs once in the corpus are unique, so their super-k-mers stay
at home; a bitmap tells, of some 64 bits for each repeated minimiser but 64 MB at most (collisions only let more travel). Super-k-mers of minimisers that occur over `hot` times
are counted as whole strings first, by a pre-aggregated group; then only the windows of distinct strings go to a bucket each. So no bucket holds more
than `hot` super-k-mers. A word is removed if a window that covers it occurs more than once. Documents without such words, which another bitmap tells, are not shuffled.

A null text has no words. Documents of fewer words than a window lose none. Repeated rows count as further occurrences and keep a row each. Very long texts
are cut into stretches of windows, which overlap by their words. Empty tables give empty results. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import Staged, bitmap, groups, marked_in, partitions, slices, stage, utf8

WIDTH, INNER, HOT = 35, 11, 1024
_STRETCH = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word to hash; forgets all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _minimisers(hashes: np.ndarray, width: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its minimiser's hash and place."""
    n = len(hashes) - inner + 1
    grams = np.zeros(n, np.uint64)
    for k in range(inner):
        grams = grams * _PRIME + hashes[k : k + n]
    grams ^= grams >> np.uint64(32)
    grams *= _MIX
    grams ^= grams >> np.uint64(29)
    keys = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span, reach = width - inner + 1, 1
    low = keys
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    places = (low & _PLACE).astype(np.int64)
    return grams[places], places


def super_kmers(texts: list[list[bytes]], hashes: _Hashes, width: int, inner: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, place of the text counted from it, minimiser hash, first window, end window) of the texts' super-k-mers, for some texts or a stretch of one at a time."""
    for begin, part in _together(texts, width):
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.cumsum(lengths) - lengths
        if len(part) > 1:
            values = np.fromiter(map(hashes.__getitem__, chain.from_iterable(part)), np.uint64, int(lengths.sum()))
            yield begin, *_of_texts(values, starts, lengths, 0, width, inner)
            continue
        for at in range(0, len(part[0]) - width + 1, _STRETCH):
            some = part[0][at : at + _STRETCH + width - 1]
            values = np.fromiter(map(hashes.__getitem__, some), np.uint64, len(some))
            yield begin, *_of_texts(values, starts, np.array([len(some)]), at, width, inner)


def _together(texts: list[list[bytes]], width: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts of some ten thousand words together, and those of a stretch and more alone; (place of the first, texts)."""
    begin, size = 0, 0
    for i, words in enumerate(texts):
        if i > begin and (size > 50_000 or len(words) >= _STRETCH):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(words)
    if begin < len(texts):
        yield begin, texts[begin:]


def _of_texts(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shift: int, width: int, inner: int) -> tuple[np.ndarray, ...]:
    if len(values) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams, places = _minimisers(values, width, inner)
    own = np.repeat(np.arange(len(lengths)), lengths)[: len(places)]
    windows = np.flatnonzero(np.arange(len(places)) + width <= (starts + lengths)[own])  # those that lie in one text
    places, first = places[windows], np.zeros(0, np.int64)
    if len(windows):
        first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    ends = windows[np.append(first[1:], len(windows)) - 1] + 1
    begins = windows[first]
    text = own[begins]
    return text, grams[begins], begins - starts[text] + shift, ends - starts[text] + shift


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64), pa.int64())


def repeated(docs: DataFrame, width: int = WIDTH, inner: int = INNER, hot: int = HOT) -> DataFrame:
    """doc_id, _row (a hash of doc_id and text), and runs: array of (first, end) of windows that occur more than once. Documents without any are left out."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("_row"), utf8("text").alias("text"))

    def count(batches):
        hashes = _Hashes()
        for batch in slices(batches, 0):
            found = [x[2] for x in super_kmers([t.split() for t in batch.column(0).to_pylist()], hashes, width, inner)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found) if found else [])], ["h"])

    counts = texts.select("text").mapInArrow(count, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    counts = stage(counts, "minimisers")
    shared = spark.sparkContext.broadcast((bitmap(counts.select("h")), bitmap(counts.where(F.col("n") > hot).select("h"))))

    def send(batches):
        hashes, (twice, often) = _Hashes(), shared.value
        names = ["key", "alone", "doc_id", "_row", "firsts", "packed"]
        for batch in slices(batches, 2):
            docs_, rows_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts_ = [t.split() for t in batch.column(2).to_pylist()]
            rows: list[tuple] = []
            for begin, text, grams, first, end in super_kmers(texts_, hashes, width, inner):
                keep = np.flatnonzero(marked_in(twice, grams))
                cuts = np.flatnonzero(np.diff(text[keep])) + 1
                many = marked_in(often, grams[keep])
                for some, hot_ in zip(np.split(keep, cuts), np.split(many, cuts), strict=True):
                    if not len(some):
                        continue
                    i = begin + int(text[some[0]])
                    words = texts_[i]
                    lengths = np.fromiter(map(len, words), np.int64, len(words))
                    ends = np.cumsum(lengths + 1) - 1
                    flat, own = b" ".join(words), {}
                    from_, to = (ends - lengths)[first[some]].tolist(), ends[end[some] + width - 2].tolist()
                    for g, a, x, y, m in zip(grams[some].tolist(), first[some].tolist(), from_, to, hot_.tolist(), strict=True):
                        own.setdefault((g, m, flat[x:y]), []).append(a)
                    rows += [(g, m, docs_[i], rows_[i], firsts, packed) for (g, m, packed), firsts in own.items()]  # equal ones of a document travel once
                if len(rows) > 20_000:
                    yield _rows(rows, names)
                    rows = []
            yield _rows(rows, names)

    written = Staged(texts.mapInArrow(send, "key long, alone boolean, doc_id long, _row long, firsts array<long>, packed binary"), "super-k-mers")
    sent = written.df

    def judge(batches):
        for group in groups(batches, "key"):
            if group.num_rows > 1 or len(group.column("firsts")[0]) > 1:
                yield _judged(group, width)

    cold = sent.where("not alone").select("key", "doc_id", "_row", "firsts", "packed")
    cold = cold.repartition(partitions(spark, written.octets()), "key").sortWithinPartitions("key").mapInArrow(judge, "doc_id long, _row long, runs array<struct<first: long, end: long>>")
    runs = cold.unionByName(_hot_runs(sent.where("alone"), width))
    # A document's runs are at most as many as its windows; rows that agree in doc_id and text share them.
    return runs.groupBy("doc_id", "_row").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def _hot_runs(sent: DataFrame, width: int) -> DataFrame:
    """doc_id, _row and runs of super-k-mers with frequent minimisers: equal strings are counted as one, and only windows of distinct strings are dealt out."""
    strings = stage(sent.groupBy("key", "packed").agg(F.sum(F.size("firsts")).alias("n")).withColumn("sid", F.monotonically_increasing_id()), "strings")

    def cut(batches):
        for batch in batches:
            rows = []
            for packed, n, sid in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = packed.split(b" ")
                rows += [(sid, w, n, b" ".join(words[w : w + width])) for w in range(len(words) - width + 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["sid", "w", "n", "words"])

    windows = strings.select("packed", "n", "sid").mapInArrow(cut, "sid long, w long, n long, words binary")
    again = windows.groupBy("words").agg(F.sum("n").alias("n")).where("n > 1").select("words")
    # All windows of a string that occurs twice do; those of the others are looked up.
    marks = windows.where("n = 1").join(again, "words", "left_semi").groupBy("sid").agg(F.collect_list("w").alias("ws"))
    held = strings.join(marks.withColumnRenamed("sid", "marked"), F.col("sid") == F.col("marked"), "left").where("n > 1 or ws is not null").select("key", "packed", "ws")
    many = F.size(F.split(F.col("packed").cast("string"), " ")) - width + 1
    spread = F.flatten(F.transform("firsts", lambda f: F.transform("ws", lambda w: F.struct((f + w).alias("first"), (f + w + 1).alias("end")))))
    all_ = F.transform("firsts", lambda f: F.struct(f.alias("first"), (f + many).cast("long").alias("end")))
    return sent.join(held, ["key", "packed"]).select("doc_id", "_row", F.when(F.col("ws").isNull(), all_).otherwise(spread).alias("runs"))


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (None, pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([_signed(np.array(cols[0], np.uint64)), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True))], names)


def _judged(group: pa.Table, width: int) -> pa.RecordBatch:
    """The runs of a bucket's windows that occur more than once: its distinct strings cut into windows, sorted and counted."""
    holders: dict[bytes, list[int]] = {}
    for i, packed in enumerate(group.column("packed").to_pylist()):
        holders.setdefault(packed, []).append(i)
    if len(holders) == 1:  # equal strings: all their windows occur again
        return _runs(group, [list(range(next(iter(holders)).count(b" ") + 2 - width))], holders)
    entries = []
    for s, packed in enumerate(holders):
        words = packed.split(b" ")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        entries += [(packed[a:b], s, w) for w, (a, b) in enumerate(zip(starts, ends[width - 1 :].tolist(), strict=False))]
    entries.sort()
    firsts = group.column("firsts").to_pylist()
    weight = [sum(len(firsts[i]) for i in x) for x in holders.values()]
    twice: list[list[int]] = [[] for _ in weight]
    at = 0
    while at < len(entries):
        end = at + 1
        while end < len(entries) and entries[end][0] == entries[at][0]:
            end += 1
        if end - at > 1 or weight[entries[at][1]] > 1:
            for _, s, w in entries[at:end]:
                twice[s].append(w)
        at = end
    return _runs(group, twice, holders)


def _runs(group: pa.Table, twice: list[list[int]], holders: dict[bytes, list[int]]) -> pa.RecordBatch:
    """The documents' runs, for the windows that occur again of each string and the rows that hold it."""
    docs, rows, firsts = (group.column(c).to_pylist() for c in ("doc_id", "_row", "firsts"))
    out: list[tuple] = []
    for windows, members in zip(twice, holders.values(), strict=True):
        if windows:
            windows.sort()
            cuts = [0, *(i for i in range(1, len(windows)) if windows[i] != windows[i - 1] + 1), len(windows)]
            runs = [(windows[a], windows[b - 1] + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
            out += [(docs[i], rows[i], [{"first": f + a, "end": f + b} for f in firsts[i] for a, b in runs]) for i in members]
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), _RUNS), strict=True)], ["doc_id", "_row", "runs"])


def kept_words(words: list[bytes], runs: list[dict] | None, width: int) -> list[bytes]:
    if not runs:
        return words
    covered = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        covered[r["first"]] += 1
        covered[r["end"] - 1 + width] -= 1
    gone = np.cumsum(covered)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row of docs."""
    found = stage(repeated(docs, width, inner, hot).select(F.col("doc_id").alias("d"), F.col("_row").alias("r"), "runs"), "runs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("_row"), utf8("text").alias("text"))
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(F.col("r").alias("h"))))
    shape = "doc_id long, n_words long, n_removed long, kept binary"

    def out_of(ids: pa.Array, texts: pa.Array, runs: list) -> pa.RecordBatch:
        out = []
        for text, own in zip(texts.to_pylist(), runs, strict=True):
            words = text.split()
            kept = kept_words(words, own, width)
            out.append((len(words), len(words) - len(kept), b" ".join(kept)))
        n, gone, kept = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    def whether(batch: pa.RecordBatch) -> np.ndarray:
        return marked_in(marked.value, batch.column(1).to_numpy().view(np.uint64))

    def untouched(batches):
        for batch in slices(batches, 2):
            rest = batch.filter(pa.array(~whether(batch)))
            yield out_of(rest.column(0), rest.column(2), [None] * rest.num_rows)

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(whether(batch)))

    def of(batches):
        for batch in slices(batches, 1):
            yield out_of(batch.column(0), batch.column(1), batch.column(2).to_pylist())

    some = texts.mapInArrow(touched, "doc_id long, _row long, text binary")
    joined = some.join(found, (F.col("_row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "runs")
    return texts.mapInArrow(untouched, shape).unionByName(joined.mapInArrow(of, shape))
