"""Language identification, word first with backoff to shorter character n-grams.

A known word adds its per-language log frequency; an unseen one the mean log frequency of its longest known
n-grams, from `GRAMS[0]` characters down to single ones, word borders included. The language with the
largest sum wins, ties by its name; the score is its share of the posterior.

The model is fitted on a bounded, hash-chosen sample of the labelled rows, about `sample` for each language, and keeps its `words`
most frequent words and `grams` most frequent n-grams of each order, so its size has a bound whatever the corpus.

Texts that are null or have no letter get `und` with score 0; so do all texts where nothing was learned. Rows with a null lang or null doc_id
teach nothing; rows are judged one by one, so repeated rows keep a row each. Empty tables give empty results. Columns other than doc_id,
text and lang are ignored; lang is read for learning only.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm._shared import of_worker, slices

SAMPLE, WORDS, GRAMS_KEPT, GRAMS = 3000, 40_000, 8_000, (5, 4, 3, 2, 1)
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose log frequencies a worker keeps, some 20 MB.
_CACHE = 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def train(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS_KEPT) -> dict:
    """The model: languages, for order 0 (words) and each n the place of each gram, and the log frequencies by place and language. docs: the rows to learn from."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count()
    share = F.broadcast(sizes.select(F.col("lang").alias("l"), (F.lit(float(sample)) / F.col("count")).alias("share")))
    chosen = rows.join(share, F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def words_counted(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            found = [(lang, w, k) for lang, words_ in seen.items() for w, k in words_.items()]
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "c"])

    def grams_counted(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found[lang, 0, word] += k
                for n in GRAMS:
                    for g in grams_of(word, n):
                        found[lang, n, g] += k
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "n", "gram", "c"])

    # n-grams are cut of the distinct words only.
    distinct = chosen.select("text", "lang").mapInArrow(words_counted, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counted = distinct.mapInArrow(grams_counted, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    top = counted.withColumn("at", F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))).where(F.col("at") <= F.when(F.col("n") == 0, words).otherwise(grams))
    found = top.select("lang", "n", "gram", "c").toArrow()
    return fit(row for batch in found.to_batches(max_chunksize=10_000) for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))


def fit(counts: Iterable[tuple[str, int, str, int]]) -> dict:
    """The model from (lang, n, gram, count). What is held of a count are three numbers."""
    logs: dict[int, dict[str, int]] = {n: {} for n in (0, *GRAMS)}
    codes: dict[str, int] = {}
    places, of, held = array("q"), array("q"), array("q")
    begun = array("q", [-1])  # the n of each place; place 0 is of what no table knows
    for lang, n, gram, c in counts:
        place = logs[n].setdefault(gram, len(begun))
        if place == len(begun):
            begun.append(n)
        places.append(place)
        of.append(codes.setdefault(lang, len(codes)))
        held.append(c)
    langs = sorted(codes)
    column = np.array([langs.index(lang) for lang in codes], np.int64)[np.array(of, np.int64)] if codes else np.empty(0, np.int64)
    rows, order = np.zeros((len(begun), max(1, len(langs)))), np.array(begun)
    rows[np.array(places, np.int64), column] = held
    for n in logs:
        of_n = order == n
        if of_n.any():
            whole = rows[of_n].sum(0) + 0.5 * of_n.sum() + 1
            rows[of_n] = np.log(rows[of_n] + 0.5) - np.log(whole)
    return {"langs": langs, "logs": logs, "rows": rows}


class Scorer:
    """Scores texts; the log frequencies of words seen before come from a bounded cache."""

    def __init__(self, model: dict):
        self.langs, self.rows = model["langs"], model["rows"]
        self.order = list(model["logs"].items())
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, self.rows.shape[1]))
        self.letters = np.zeros(1024, bool)

    def _found(self, word: str) -> list[int]:
        """Rows of the word, or else of its longest known n-grams."""
        if not word.isalpha() and not any(map(str.isalpha, word)):
            return [0]
        for n, table in self.order:
            if n == 0:
                if (row := table.get(word)) is not None:
                    return [row]
                continue
            padded = f"\x02{word}\x03" if n > 1 else word
            found = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table]
            if found:
                return found
        return [0]

    def learn(self, words: list[str]) -> None:
        """Adds words to the cache; one of several n-grams counts as their mean."""
        start, rows, begins = len(self.at), [], []
        for w in words:
            begins.append(len(rows))
            rows += self._found(w)
        while start + len(words) > len(self.table):
            self.table, self.letters = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        sums = np.add.reduceat(self.rows[rows], begins, axis=0)
        self.table[start : start + len(words)] = sums / np.diff([*begins, len(rows)])[:, None]
        self.letters[start : start + len(words)] = [w.isalpha() or any(map(str.isalpha, w)) for w in words]
        self.at.update(zip(words, range(start, start + len(words)), strict=True))

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        words = words_of(text)
        if len(self.at) > _CACHE:
            self._forget()
        if unseen := set(words).difference(self.at):
            self.learn(list(unseen))
        places = np.fromiter(map(self.at.__getitem__, words), np.intp, len(words))
        if not self.letters[places].any():
            return UNDETERMINED, 0.0
        total = self.table.take(places, axis=0).sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def of(batches):
        scorer = of_worker(("language", key), lambda: Scorer(shared.value))
        for batch in slices(batches, 1):
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is under least. The row travels with its verdict."""
    shared, columns, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns, uuid.uuid4().hex
    at = columns.index("text")

    def of(batches):
        scorer = of_worker(("language", key), lambda: Scorer(shared.value))
        for batch in slices(batches, at):
            found = [scorer.score(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
