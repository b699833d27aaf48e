"""Ordered sequences: runs, latches, sessions, fills and samples, by windows over (source, position)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(part: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*part).orderBy(*order)


def with_runs(df: DataFrame, part: Sequence[str], order: Sequence[str], member: Column, key: Column, out: str = "run") -> DataFrame:
    """Adds the number of the run, from 0, to members: consecutive rows that are members and share key. Others get null, and break runs."""
    w = ordered(part, order)
    held = df.withColumn("_m", F.coalesce(member, F.lit(False))).withColumn("_k", key)
    starts = F.col("_m") & ~(F.coalesce(F.lag("_m").over(w), F.lit(False)) & F.lag("_k").over(w).eqNullSafe(F.col("_k")))
    running = F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return held.withColumn("_s", starts).withColumn(out, F.when(F.col("_m"), running).cast("long")).drop("_m", "_k", "_s")


def with_skipping_runs(df: DataFrame, part: Sequence[str], order: Sequence[str], key: Column, out: str = "run") -> DataFrame:
    """Adds run numbers where key is not null; rows with a null key neither belong to a run nor break one."""
    w = ordered(part, order)
    held = df.withColumn("_k", key)
    before = F.last("_k", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = F.col("_k").isNotNull() & ~before.eqNullSafe(F.col("_k"))
    held = held.withColumn("_s", starts)
    running = F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return held.withColumn(out, F.when(F.col("_k").isNotNull(), running).cast("long")).drop("_k", "_s")


def latch(df: DataFrame, part: Sequence[str], order: Sequence[str], sets: Column, holds: Column, out: str = "flag") -> DataFrame:
    """Adds flag[i] = sets[i] or (holds[i] and flag[i-1]), without a recurrence: the last set lies after the last row that neither sets nor holds."""
    w = ordered(part, order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("_i", F.row_number().over(w)).withColumn("_a", F.coalesce(sets, F.lit(False))).withColumn("_b", F.coalesce(holds, F.lit(False)))
    on = F.last(F.when(F.col("_a"), F.col("_i")), ignorenulls=True).over(upto)
    off = F.last(F.when(~F.col("_a") & ~F.col("_b"), F.col("_i")), ignorenulls=True).over(upto)
    return held.withColumn(out, F.coalesce(on > F.coalesce(off, F.lit(-1)), F.lit(False))).drop("_i", "_a", "_b")


def last_of_run(df: DataFrame, part: Sequence[str], order: str, run: str, candidate: Column, out: str = "kept") -> DataFrame:
    """Marks the last candidate of each run."""
    w = W.partitionBy(*part, run)
    last = F.max(F.when(candidate, F.col(order))).over(w)
    return df.withColumn(out, F.col(run).isNotNull() & F.coalesce(candidate, F.lit(False)) & (F.col(order) == last))


def repair_sample(df: DataFrame, part: Sequence[str], order: str, edge: int = 6, middles: int = 6) -> DataFrame:
    """The first and last rows of each sequence and evenly spaced ones between, newest first by column pick."""
    w = W.partitionBy(*part).orderBy(order)
    held = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_last", F.count("*").over(W.partitionBy(*part)) - 1)
    spaced = F.exists(F.sequence(F.lit(0), F.lit(middles - 1)), lambda s: F.round(s * F.col("_last") / (middles - 1)).cast("long") == F.col("_at"))
    kept = held.where((F.col("_at") < edge) | (F.col("_at") > F.col("_last") - edge) | spaced).drop("_at", "_last")
    return kept.withColumn("pick", F.row_number().over(W.partitionBy(*part).orderBy(F.desc(order))).cast("long"))


def within_budget(df: DataFrame, part: Sequence[str], order: Sequence[Column], wanted: Column, budget: int = 3, out: str = "probed") -> DataFrame:
    """Marks the rows that are among the first `budget` wanted ones in order."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(wanted, F.lit(False)) & (F.sum(F.when(wanted, 1).otherwise(0)).over(w) <= budget))
