"""Votes: which of a group's values holds, if any. All are two aggregations over (group, value), which combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tally(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n for the values present."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def _leaders(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, v, n, runner (the second count or 0), total, n_distinct. One shuffle by keys; only two rows of a group pass the rank."""
    whole = W.partitionBy(*keys)
    ranked = counts.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("n"), F.col(value)))).withColumn("_total", F.sum("n").over(whole)).withColumn("_distinct", F.count("*").over(whole))
    first = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
    return ranked.where("_rank <= 2").groupBy(*keys).agg(first(value).alias("v"), first("n").alias("n"), F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("n"))), F.lit(0)).alias("runner"), F.max("_total").alias("total"), F.max("_distinct").alias("n_distinct"))


def vote(df: DataFrame, keys: Sequence[str], value: str, min_count: int = 3, ratio: float = 2.0, share: float = 0.0, counted: bool = False) -> DataFrame:
    """keys, selected, n_distinct: the only value, or one with min_count votes, ratio times the runner-up's, and that share of all.

    A tie never wins under a ratio over 1, so the order among ties doesn't show. counted: df has n already.
    """
    found = _leaders(df if counted else tally(df, keys, value), keys, value)
    wins = (F.col("n_distinct") == 1) | ((F.col("n") >= min_count) & (F.col("n") >= ratio * F.col("runner")) & (F.col("n") >= share * F.col("total")))
    return found.select(*keys, F.when(wins, F.col("v")).alias("selected"), "n_distinct")


def text_vote(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The only value, or one with two votes and more than any other."""
    found = _leaders(tally(df, keys, value), keys, value)
    return found.select(*keys, F.when((F.col("n_distinct") == 1) | ((F.col("n") >= 2) & (F.col("n") > F.col("runner"))), F.col("v")).alias("selected"), "n_distinct")


def cp_vote(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, selected: the vote over combat points. Among values of 100 and more, one that longer readings extend by a digit wins first."""
    keys = list(keys)
    counts = tally(df, keys, value).withColumnRenamed(value, "v")
    single = counts.groupBy(*keys).agg(F.when(F.count("*") == 1, F.max("v")).alias("one"), F.max("v").alias("most"))
    high = counts.where("v >= 100")
    longer = high.where("v >= 1000").withColumn("stem", F.expr("v div 10"))
    variants = longer.groupBy(*keys, "stem").agg(F.count("*").alias("variants"), F.max("n").alias("best"), F.sum("n").alias("total"))
    stemmed = high.join(variants.withColumnRenamed("stem", "v"), [*keys, "v"])
    exact = stemmed.where("n >= 3 or (variants = 1 and best >= 2)").groupBy(*keys).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("exact"))
    shared = variants.where("variants >= 4 and total >= 3").groupBy(*keys).agg(F.max_by("stem", F.struct("total", -F.col("stem"))).alias("shared"))
    upper = vote(high, keys, "v", counted=True).select(*keys, F.col("selected").alias("upper"))
    every = vote(counts, keys, "v", counted=True).select(*keys, F.col("selected").alias("every"))
    joined = single
    for side in (exact, shared, upper, every):
        joined = joined.join(side, keys, "left")
    picked = F.coalesce("one", F.when(F.col("most") >= 100, F.coalesce("exact", "shared", "upper")).otherwise(F.col("every")))
    return joined.select(*keys, picked.alias("selected"))


# Votes within a row: arrays of (v, n), one entry for each distinct value. They are bounded by the distinct values of one group.


def _order(votes: Column) -> Column:
    """By count downwards, then by value."""
    return F.array_sort(F.transform(votes, lambda x: F.struct((-x["n"]).alias("m"), x["v"].alias("v"))))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def choice(votes: Column, least: int = 3, ratio: float = 2.0, share: float = 0.0, strictly: bool = False) -> Column:
    """The only value, or one with `least` votes, `ratio` times the runner-up's (more than its, if strictly), and that share of all; null otherwise."""

    def of(s: Column) -> Column:
        top, runner = -F.get(s, F.lit(0))["m"], F.coalesce(-F.get(s, F.lit(1))["m"], F.lit(0))
        wins = (top >= least) & ((top > runner) if strictly else (top >= ratio * runner))
        if share:
            wins = wins & (top >= share * F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a - x["m"]))
        return F.when((F.size(s) == 1) | ((F.size(s) > 1) & wins), F.get(s, F.lit(0))["v"])

    return _bound(_order(votes), of)


def cp_choice(votes: Column, low: int = 10, high: int = 9366) -> Column:
    """The choice over combat points (v a long). Among values of 100 and more, one that longer readings extend by a digit wins first, then a stem that four of them share."""

    def clear(tall: Column, long: Column) -> Column:
        own = lambda stem: F.filter(long, lambda y: y["p"] == stem)
        extended = F.filter(tall, lambda x: _bound(own(x["v"]), lambda o: ((F.size(o) > 0) & (x["n"] >= 3)) | ((F.size(o) == 1) & (F.get(o, F.lit(0))["n"] >= 2))))
        stems = F.array_distinct(F.transform(long, lambda x: x["p"]))
        weighed = F.transform(stems, lambda p: _bound(own(p), lambda o: F.struct(F.aggregate(o, F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("n"), p.cast("long").alias("v"), F.size(o).alias("k"))))
        shared = F.filter(weighed, lambda x: (x["k"] >= 4) & (x["n"] >= 3) & x["v"].between(low, high))
        return F.coalesce(F.get(_order(extended), F.lit(0))["v"], F.get(_order(shared), F.lit(0))["v"], choice(tall))

    def of(sound: Column) -> Column:
        stemmed = lambda tall: F.transform(F.filter(tall, lambda x: x["v"] >= 1000), lambda x: F.struct(F.floor(x["v"] / 10).alias("p"), x["n"].alias("n")))
        upper = _bound(F.filter(sound, lambda x: x["v"] >= 100), lambda tall: F.when(F.size(tall) > 0, _bound(stemmed(tall), lambda long: clear(tall, long))).otherwise(choice(sound)))
        return F.when(F.size(sound) == 1, F.get(sound, F.lit(0))["v"]).otherwise(upper)

    return _bound(F.filter(votes, lambda x: x["v"].between(low, high)), of)


def star_choice(votes: Column, sums: Column) -> Column:
    """The stars that the chosen sum of values calls for, if they were seen; else the choice. v are texts of whole numbers."""
    from orrery.functions.scoring import star_tier

    called = star_tier(choice(sums).try_cast("long")).cast("string")
    return F.when(F.exists(votes, lambda x: x["v"] == called), called).otherwise(choice(votes))
