"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm, as islands with elite migration.

Documents are tokenised whole; only those longer than a sequence are cut, into pieces of its length and a rest. Full pieces are sequences of their own. The
others are dealt by a hash of their contents to shards of about `shard` pieces. Several islands evolve each shard from best-fit packings: crossover injects
whole well-filled bins of one parent into the other, both ways, removes the bins that hold duplicates, and best-fits the displaced pieces, longest first;
mutation empties some bins, exchanges what they held for smaller items that fill other bins less, and best-fits the rest. A child takes the place of the worst of its island, unless
one of its fitness is there. After each epoch every island hands its elite on to the next one of its shard; the best packing of all islands wins. Then the
emptiest bins of all shards are packed again together, in fewer shards, until one is left. Seeds and orders follow from the contents, so reruns agree,
but for the numbers of sequences and for which of several equal rows lies where.

A null text counts as empty: one token, the end mark. Repeated rows are packed each. Empty tables give empty results. Columns other than doc_id and text are ignored
by `pieces`; `pack` takes any table with a length column and keeps its other columns, whose names must not begin with `__or_`.
"""

from __future__ import annotations

import os
import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import of_worker, partitions, slices, stage, utf8

CAPACITY, SHARD, ISLANDS, EPOCHS = 2048, 4096, 2, 2
POPULATION, GENERATIONS, PATIENCE = 10, 60, 5
#: Words whose ids a worker keeps, some 45 MB, and as many that it met before.
_CACHE = 250_000
#: Texts are encoded in groups of about this many octets, words new to the cache in lines of so many.
_GROUP, _LINE = 1 << 20, 256
#: Letters (or octets beyond ASCII) and then ASCII punctuation other than apostrophes.
_PARTED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")


def _lettered(words: list[bytes]) -> list[bool]:
    """Whether each word (without line breaks) is of letters alone."""
    whole = unicodedata.normalize("NFC", b"\n".join(words).decode("utf-8", "replace")).lower()
    return list(map(str.isalpha, whole.split("\n"))) if words else []


class _Rows(dict):
    """Numbers of words, given as they come; new ones are also listed."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.fresh.append(word)
        return row


class _Store:
    """Ids of numbered words, one after another."""

    def __init__(self):
        self.rows, self.ids, self.ends, self.held = _Rows(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, found: list[bytes]) -> None:
        """Ids of the next words."""
        flat, lengths = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = int(self.ends[self.held])
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + len(found) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at : at + len(flat)] = flat
        self.ends[self.held + 1 : self.held + 1 + len(found)] = at + np.cumsum(lengths)
        self.held += len(found)

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that it holds."""
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        flat = self.gather(rows).tobytes()
        cuts = (np.cumsum(self.ends[rows + 1] - self.ends[rows]) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class Tokens:
    """Ids of texts, little-endian, 4 octets each. ASCII white space always parts this tokeniser's words, so words are encoded once and kept in a bounded cache, which
    hands on what is in use when it turns over.

    Where the tokeniser folds case and parts punctuation from letters, which probes find out, so does the cache. Words of letters alone are encoded many to a line,
    which is cut after the ids that end a word; a line whose ends don't number its words is encoded word by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.now, self.before, self.tokenizer = _Store(), _Store(), Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        probe, mixed, letters, point = self._encoded([b"word!?),", b"WoRD!?),", b"word", b"!?),"])
        self.folds, self.parts = probe == mixed, probe == letters + point

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _in_lines(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters."""
        lines = [words[i : i + _LINE] for i in range(0, len(words), _LINE)]
        out: list[bytes] = []
        for line, found in zip(lines, self._encoded([b" ".join(x) for x in lines]), strict=True):
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(found, "<u4")]) + 1) * 4).tolist()
            if len(cuts) == len(line) and cuts[-1] == len(found):
                out += [found[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self._encoded(line)
        return out

    def _learn(self) -> None:
        """Finds the ids of the words that are new to the store."""
        rows, before = self.now.rows, self.before.rows
        words = rows.fresh
        again = [w for w in words if w in before]
        found = dict(zip(again, self.before.of(again), strict=True))
        new, split = [w for w in words if w not in found] if again else words, {}
        if self.parts:
            parted = {w: m.groups() for w, m in zip(new, map(_PARTED.fullmatch, new), strict=True) if m}
            sound = _lettered([a for a, _ in parted.values()])
            split = {w: pair for (w, pair), ok in zip(parted.items(), sound, strict=True) if ok}
            at = len(words)
            for a, b in split.values():
                rows[a], rows[b]  # what they are made of is numbered too
            more = words[at:]
            again = [w for w in more if w in before]
            found.update(zip(again, self.before.of(again), strict=True))
            new = [w for w in chain(new, more) if w not in split and w not in found]
        letters = _lettered(new)
        lettered, others = list(compress(new, letters)), [w for w, ok in zip(new, letters, strict=True) if not ok]
        found.update(zip(lettered, self._in_lines(lettered), strict=True))
        found.update(zip(others, self._encoded(others), strict=True))
        held = list({w for pair in split.values() for w in pair}.difference(found))
        found.update(zip(held, self.now.of(held), strict=True))
        found.update((w, found[a] + found[b]) for w, (a, b) in split.items())
        self.now.add([found[w] for w in words])
        rows.fresh = []

    def _words(self, text: bytes) -> list[bytes]:
        return (text.lower() if self.folds and b"<|" not in text else text).split()  # special tokens keep their case

    def ids(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text, a group of texts at a time."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            if not held and len(self.now.rows) > _CACHE:
                self.now, self.before = _Store(), self.now
            words = self._words(text)
            held.append(np.fromiter(map(self.now.rows.__getitem__, words), np.int64, len(words)))
            size += len(text)
            if size >= _GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, held: list[np.ndarray]) -> Iterator[bytes]:
        if self.now.rows.fresh:
            self._learn()
        for rows in held:
            yield self.now.gather(rows).tobytes()


_OPEN = 16  # a bin with a sixteenth of its capacity free, or more, is packed again with those of other shards


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each document's pieces."""

    def of(batches):
        tokens, end = of_worker(("tokens", tokenizer_path), lambda: Tokens(tokenizer_path)), int(end_id).to_bytes(4, "little")
        for batch in slices(batches, 1):
            rows = []
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(of, kinds)


class Packing:
    """Bins of items; free space of at most `capacity` keeps a stack of bins for each amount, found by a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.left = capacity, [], []
        self.open: dict[int, list[int]] = {}
        self.mask = 0

    def add_bin(self, items: list[int], left: int) -> None:
        self.open.setdefault(left, []).append(len(self.bins))
        self.mask |= 1 << left
        self.bins.append(items)
        self.left.append(left)

    def best_fit(self, item: int, size: int) -> None:
        """Puts an item in the fullest bin that has room, or else in a new one."""
        if not (above := self.mask >> size):
            self.add_bin([item], self.capacity - size)
            return
        left = size + (above & -above).bit_length() - 1
        stack = self.open[left]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << left
        self.bins[b].append(item)
        self.left[b] = left - size
        self.open.setdefault(left - size, []).append(b)
        self.mask |= 1 << left - size

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then the sum of squared fills."""
        return -len(self.bins), sum((self.capacity - x) ** 2 for x in self.left)


def best_fit(order: list[int], sizes: list[int], capacity: int) -> Packing:
    out = Packing(capacity)
    for i in order:
        out.best_fit(i, sizes[i])
    return out


def longest_first(items: Iterable[int], sizes: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def crossover(a: Packing, b: Packing, sizes: list[int], rng: random.Random) -> Packing:
    """A child of a with well-filled bins of b."""
    full = sorted(range(len(b.bins)), key=lambda k: (b.left[k], rng.random()))
    chosen = [k for k in full[: max(1, len(full) // 2)] if rng.random() < 0.5] or full[:1]
    child, taken = Packing(a.capacity), set()
    for k in chosen:
        child.add_bin(list(b.bins[k]), b.left[k])
        taken.update(b.bins[k])
    displaced = []
    for items, left in zip(a.bins, a.left, strict=True):
        if taken.isdisjoint(items):
            child.add_bin(list(items), left)
        else:
            displaced += [i for i in items if i not in taken]
    for i in longest_first(displaced, sizes):
        child.best_fit(i, sizes[i])
    return child


def _swap(items: list[int], room: int, free: list[tuple[int, int]], sizes: list[int]) -> int:
    """Exchanges one item of a bin for one or two displaced ones (sorted by size) that fill it better; the gain."""
    best, out, into = 0, None, ()
    for i in items:
        s = sizes[i]
        k = bisect_right(free, (s + room, 1 << 62)) - 1
        if k >= 0 and free[k][0] - s > best:
            best, out, into = free[k][0] - s, i, (k,)
        for small in range(min(len(free), 24)):
            k = bisect_right(free, (s + room - free[small][0], 1 << 62)) - 1
            if k <= small:
                break
            if free[k][0] + free[small][0] - s > best:
                best, out, into = free[k][0] + free[small][0] - s, i, (small, k)
        if best == room:
            break
    if best:
        items.remove(out)
        items += [free[k][1] for k in into]
        for k in sorted(into, reverse=True):
            del free[k]
        insort(free, (sizes[out], out))
    return best


def mutation(p: Packing, sizes: list[int], rng: random.Random, few: int = 3) -> Packing:
    """p without its emptiest bin and some at random; what they held is exchanged for smaller items of other bins, and best-fitted."""
    n = len(p.bins)
    emptiest = max(range(n), key=lambda k: (p.left[k], rng.random()))
    gone = {emptiest, *(rng.randrange(n) for _ in range(few))}
    free = sorted((sizes[i], i) for k in gone for i in p.bins[k])
    child = Packing(p.capacity)
    for k in rng.sample(range(n), n):
        if k not in gone:
            items, left = p.bins[k], p.left[k]
            if left and free and (gain := _swap(items := list(items), left, free, sizes)):
                left -= gain
            child.add_bin(list(items), left)
    for s, i in reversed(free):
        child.best_fit(i, s)
    return child


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound: items over half a bin need one each, and what smaller ones don't find beside them needs more."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    sums = np.concatenate([[0], np.cumsum(s)])
    at = lambda x, side: np.searchsorted(s, x, side)
    small = np.unique(np.concatenate([[0], s[2 * s <= capacity]]))
    half, first, long = at(capacity // 2, "right"), at(small, "left"), at(capacity - small, "right")
    room = (long - half) * capacity - (sums[long] - sums[half])
    return int(np.max(len(s) - half + np.maximum(0, -(-(sums[half] - sums[first] - room) // capacity))))


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, patience: int = PATIENCE) -> Packing:
    """The best packing that an island finds from best-fit packings and the elites (a bin number for each item).

    The best seed's fuller bins stay; the items of the others evolve, until a lower bound is met or the best has not improved for `patience` generations.
    """
    rng, n = random.Random(seed), len(sizes)
    seeds, least = [best_fit(longest_first(range(n), sizes), sizes, capacity)], least_bins(sizes, capacity)
    if len(seeds[0].bins) == least:
        return seeds[0]
    for bins in elites:
        p, members = Packing(capacity), {}
        for i, b in enumerate(bins):
            members.setdefault(b, []).append(i)
        for items in members.values():
            p.add_bin(items, capacity - sum(sizes[i] for i in items))
        seeds.append(p)
    top = max(seeds, key=Packing.fitness)
    if len(top.bins) == least:
        return top
    # The emptiest bins evolve, as many as leave twice what would have to be saved.
    spare, enough, loose = 0, 2 * capacity * (len(top.bins) - least), []
    for b in sorted(range(len(top.bins)), key=lambda b: (-top.left[b], b)):
        if not top.left[b] or (spare >= enough and len(loose) >= 16):
            break
        spare += top.left[b]
        loose.append(b)
    fixed = [items for b, items in enumerate(top.bins) if b not in set(loose)]
    moving = sorted(i for b in loose for i in top.bins[b])
    least -= len(fixed)
    own = dict.fromkeys(moving)
    herd = [_only(p, own, sizes) for p in seeds if p is not top] + [_only(top, own, sizes)]
    while len(herd) < population:  # longest first, but for some noise
        herd.append(best_fit(sorted(moving, key=lambda i: -sizes[i] * (1 + 0.2 * rng.random())), sizes, capacity))
    fit = [p.fitness() for p in herd]
    best, still = max(fit), 0
    for _ in range(generations):
        if -best[0] <= least or still >= patience:
            break
        a, b = (max(rng.sample(range(len(herd)), 2), key=fit.__getitem__) for _ in range(2))
        children = [crossover(herd[a], herd[b], sizes, rng), crossover(herd[b], herd[a], sizes, rng), mutation(herd[a], sizes, rng)]
        children.append(mutation(children[0], sizes, rng))
        for child in children:
            f = child.fitness()
            worst = min(range(len(herd)), key=fit.__getitem__)
            if f > fit[worst] and f not in fit:  # an equal one would cost variety
                herd[worst], fit[worst] = child, f
        still = 0 if max(fit) > best else still + 1
        best = max(fit)
    out = Packing(capacity)
    for items in fixed:
        out.add_bin(items, capacity - sum(sizes[i] for i in items))
    won = herd[fit.index(best)]
    for items, left in zip(won.bins, won.left, strict=True):
        out.add_bin(items, left)
    return out


def _only(p: Packing, kept: dict[int, None], sizes: list[int]) -> Packing:
    """The packing of some of the items."""
    out = Packing(p.capacity)
    for own in p.bins:
        if some := [i for i in own if i in kept]:
            out.add_bin(some, p.capacity - sum(sizes[i] for i in some))
    return out


def _assigned(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("bins", pa.list_(pa.int64())), ("fit", pa.list_(pa.int64()))])
_STATE_DDL = "shard long, island int, sizes array<long>, keys array<long>, rows array<long>, bins array<long>, fit array<long>"
_PLACED = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("left", pa.int64())])


def _evolved(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """shard, row, key, n, bin, offset and left (free in the bin) for items of shard, row, key, n and bin (of an earlier packing, or null)."""
    spark = items.sparkSession

    def epoch_of(epoch: int):
        def of(batches):
            of_worker(("packing",), object)  # the tokeniser's cache of an earlier task goes
            for batch in batches:
                for one in range(batch.num_rows):
                    r = batch.slice(one, 1).to_pylist()[0]
                    best = evolve(r["sizes"], [e for e in r["elites"] if e], capacity, seed=r["shard"] * 1009 + r["island"] * 31 + epoch)
                    r["bins"], r["fit"] = _assigned(best, len(r["sizes"])), list(best.fitness())
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in _STATE.names}], schema=_STATE)

        return of

    # A shard is as many items as its hash deals it, `shard` on average. Their order is that of their contents, so reruns agree whatever the splits.
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key", "bin", "row")))
    herds = items.groupBy("shard").agg(order.alias("x"))
    field = lambda name: F.transform("x", lambda x: x[name])
    herds = herds.select("shard", F.transform("x", lambda x: -x["n"]).alias("sizes"), field("key").alias("keys"), field("row").alias("rows"), F.array(F.filter(field("bin"), lambda b: b.isNotNull())).alias("elites"))
    now = herds.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).repartition(partitions(spark), "shard", "island").mapInArrow(epoch_of(0), _STATE_DDL)
    for epoch in range(1, epochs):
        own = now.select("shard", "island", F.array("bins").alias("e"), "sizes", "keys", "rows")
        moved = now.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.array("bins").alias("e"), "sizes", "keys", "rows")
        met = stage(own.unionByName(moved), "migrants").groupBy("shard", "island").agg(F.flatten(F.sort_array(F.collect_list("e"))).alias("elites"), F.min("sizes").alias("sizes"), F.min("keys").alias("keys"), F.min("rows").alias("rows"))
        now = met.mapInArrow(epoch_of(epoch), _STATE_DDL)
    won = now.groupBy("shard").agg(F.max_by(F.struct("sizes", "keys", "rows", "bins"), F.struct("fit", -F.col("island"))).alias("w")).select("shard", "w.*")

    def placed(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                r = batch.slice(one, 1).to_pylist()[0]
                ends: dict[int, int] = {}
                at = []
                for n, b in zip(r["sizes"], r["bins"], strict=True):
                    at.append(ends.get(b, 0))
                    ends[b] = at[-1] + n
                many = len(at)
                yield pa.RecordBatch.from_pydict({"shard": [r["shard"]] * many, "row": r["rows"], "key": r["keys"], "n": r["sizes"], "bin": r["bins"], "offset": at, "left": [capacity - ends[b] for b in r["bins"]]}, schema=_PLACED)

    return stage(won.mapInArrow(placed, "shard long, row long, key long, n long, bin long, offset long, left long"), "placed")


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. A row without such a length is an error."""
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    sound = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("no length of a piece: "), F.coalesce(F.col("length").cast("string"), F.lit("null"))))).cast("long")
    named = [f.name for f in items.schema.fields if f.name in columns and f.dataType.simpleString() not in ("binary", "variant") and "map<" not in f.dataType.simpleString()]
    numbered = stage(items.select(*[sound.alias(c) if c == "length" else F.col(c) for c in columns], F.monotonically_increasing_id().alias("__or_row"), F.xxhash64(*named).alias("__or_key")), "items")
    whole = numbered.where(F.col("length") == capacity).select(*columns, (-F.col("__or_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    count = max(1, -(-rest.count() // shard))
    dealt = rest.select(F.pmod(F.xxhash64("__or_key"), F.lit(count)).alias("shard"), F.col("__or_row").alias("row"), F.col("__or_key").alias("key"), F.col("length").alias("n"), F.lit(None).cast("long").alias("bin"))
    level, closed = 0, []
    while True:
        placed = _evolved(dealt, capacity, islands, epochs)
        spare = placed.where(F.col("left") >= capacity // _OPEN)
        fewer = max(1, -(-spare.count() // shard)) if count > 1 else count
        if fewer >= count:
            break
        # The emptiest bins of several shards are packed again together; they are the first elite.
        closed.append(placed.where(F.col("left") < capacity // _OPEN).withColumn("level", F.lit(level)))
        dealt = spare.select((F.col("shard") % fewer).alias("shard"), "row", "key", "n", (F.col("shard") * (1 << 24) + F.col("bin")).alias("bin"))
        level, count = level + 1, fewer
    closed.append(placed.withColumn("level", F.lit(level)))
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    number = F.col("level") * F.lit(1 << 58) + F.col("shard") * (1 << 24) + F.col("bin")
    joined = rest.join(every.select("row", number.alias("__or_sequence"), F.col("offset").alias("__or_offset")), F.col("__or_row") == F.col("row"))
    return whole.unionByName(joined.select(*columns, F.col("__or_sequence").alias("sequence_id"), F.col("__or_offset").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """The pieces of docs with their sequence_id and offset."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity, with_ids), capacity, **options)
