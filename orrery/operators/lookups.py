"""Lookups that refuse ambiguity: exact, cascading, fuzzy, mentions in text.

Dimensions are joined as they come: Catalyst broadcasts those under spark.sql.autoBroadcastJoinThreshold and shuffles larger ones.
Fuzzy lookups are equi-joins on deletion variants, so no pair of all names is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_index(entries: DataFrame, name: Column, key: str) -> DataFrame:
    """norm, key: names that exactly one key claims."""
    return entries.select(name.alias("norm"), F.col(key).alias("key")).where("norm <> ''").groupBy("norm").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where("n = 1").select("norm", "key")


def exact(df: DataFrame, norm: Column, index: DataFrame, out: str) -> DataFrame:
    side = index.select(F.col("norm").alias("_n"), F.col("key").alias(out))
    return df.withColumn("_norm", norm).join(side, F.col("_norm") == F.col("_n"), "left").drop("_n", "_norm")


def deletions(norm: Column) -> Column:
    """The string and all it gives with one character taken out. Strings within one edit share one of these."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, F.length(norm))))
    return F.array_distinct(F.concat(F.array(norm), F.when(F.length(norm) > 0, cuts).otherwise(F.array().cast("array<string>"))))


def fuzzy(df: DataFrame, norm: Column, row: str, index: DataFrame, out: str, min_length: int = 5) -> DataFrame:
    """Adds the key within one edit of norm, if exactly one is, for names of min_length and more."""
    asked = df.select(F.col(row).alias("_row"), norm.alias("_norm")).where(F.length("_norm") >= min_length)
    left = asked.withColumn("_v", F.explode(deletions(F.col("_norm"))))
    right = index.where(F.length("norm") >= min_length).withColumn("_w", F.explode(deletions(F.col("norm"))))
    near = left.join(right, F.col("_v") == F.col("_w")).where(F.levenshtein("_norm", "norm", 1) >= 0)
    one = near.groupBy("_row").agg(F.count_distinct("key").alias("n"), F.min("key").alias(out)).where("n = 1").select("_row", out)
    return df.join(one, F.col(row) == F.col("_row"), "left").drop("_row")


def mentions(texts: DataFrame, row: str, words: Column, names: DataFrame) -> DataFrame:
    """row, at, n, key of the names (norm, key) that occur as whole words; texts are cut into n-grams of the lengths that names have, and equi-joined.

    Overlaps go to the leftmost, then longest.
    """
    # Distinct lengths, at most as many as the longest name has words.
    lengths = [r[0] for r in names.select(F.size(F.split("norm", " ")).alias("n")).distinct().collect()]
    wide = F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>")
    held = texts.select(F.col(row).alias("row"), words.alias("w"))
    grams = held.select("row", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda i: F.transform(wide, lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))))).alias("g"), F.size("w").alias("size"))
    grams = grams.where("g.at + g.n <= size").select("row", "g.*")
    found = grams.join(names, F.col("gram") == F.col("norm"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "key"))).alias("s"))
    empty = F.expr("cast(array() as array<struct<at: int, m: int, key: bigint>>)")
    keep = F.aggregate("s", F.struct(F.lit(0).alias("end"), empty.alias("out")), lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] - x["m"]).alias("end"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), x["m"].alias("m"), x["key"].cast("long").alias("key")))).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return spans.select("row", F.explode(keep).alias("x")).select("row", F.col("x.at").cast("long").alias("at"), (-F.col("x.m")).cast("long").alias("n"), F.col("x.key").alias("key"))


def _places(tau: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) under which a string within tau edits may hold a segment of a name that tau + 1 segments make up: one of them is untouched, with so few edits before it and so few behind it."""
    return [(d, i, s) for d in range(-tau, tau + 1) for i in range(tau + 1) for s in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)]


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a name of that length; the last ones are longer by one where it doesn't divide."""
    base, rest = F.floor(length / (tau + 1)).cast("int"), (length % (tau + 1)).cast("int")
    return i * base + F.greatest(F.lit(0), F.lit(i) - (tau + 1 - rest)), base + F.when(F.lit(i) >= tau + 1 - rest, 1).otherwise(0)


def _keyed(tau: int, length: Column, i: int, text: Column) -> Column:
    return F.struct(F.lit(tau).alias("tau"), length.cast("int").alias("length"), F.lit(i).alias("i"), text.alias("segment"))


def name_keys(norm: Column, edits: Column) -> Column:
    """Keys of a name that may be met within `edits` (1 or 2) edits: each of its segments."""
    size = F.length(norm)

    def of(tau: int) -> Column:
        parts = [(i, *_segment(size, i, tau)) for i in range(tau + 1)]
        return F.array(*[_keyed(tau, size, i, F.substring(norm, start + 1, n)) for i, start, n in parts])

    return F.when(edits == 2, of(2)).otherwise(of(1))


def text_keys(text: Column, most: Column) -> Column:
    """Keys of a text: at most 6 that meet names within one edit, and 19 more within two where `most` is 2. Any name within so many edits of it shares one."""
    size = F.length(text)

    def of(tau: int) -> list[Column]:
        out = []
        for d, i, shift in _places(tau):
            start, n = _segment(size - d, i, tau)
            whole = (size - d > tau) & (start + shift >= 0) & (start + shift + n <= size)
            out.append(F.when(whole, _keyed(tau, size - d, i, F.substring(text, start + shift + 1, n))))
        return out

    one, both = F.array(*of(1)), F.array(*of(1), *of(2))
    return F.array_distinct(F.array_compact(F.when(most == 2, both).otherwise(one)))
