"""From fragments to inventory rows: identity keys, adoption, recovery, merges, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_key(*parts: Column, weight: Column) -> Column:
    """Null unless all parts are present; the weight counts to three decimals."""
    return F.when(weight.isNotNull() & F.forall(F.array(*[p.isNotNull() for p in parts]), lambda x: x), F.concat_ws("|", *[p.cast("string") for p in parts], F.format_string("%.3f", weight)))


def adopt_unique(df: DataFrame, group: Sequence[str], key: str, out: str = "adopted") -> DataFrame:
    """Rows without a key take that of their group, if the group has exactly one."""
    only = df.where(F.col(key).isNotNull()).groupBy(*group).agg(F.count_distinct(key).alias("_n"), F.min(key).alias("_k")).where("_n = 1").select(*group, "_k")
    return df.join(only, list(group), "left").withColumn(out, F.coalesce(F.col(key), F.col("_k"))).drop("_k")


def recover_pairs(details: DataFrame, appraisals: DataFrame, group: Sequence[str], same: str) -> DataFrame:
    """Pairs (detail, appraisal) within a group: the only pair if both sides are single and agree or leave `same` open, else the only pair that agrees in it.

    Sides have columns group, id, same. Groups are counted first, so that a group with many on both sides forms no pairs but by `same`.
    """
    d, a = details.withColumnRenamed("id", "detail"), appraisals.withColumnRenamed("id", "appraisal")
    nd, na = d.groupBy(*group).agg(F.count("*").alias("nd"), F.min(same).alias("sd"), F.min("detail").alias("detail")), a.groupBy(*group).agg(F.count("*").alias("na"), F.min(same).alias("sa"), F.min("appraisal").alias("appraisal"))
    sides = nd.join(na, list(group))
    single = sides.where("nd = 1 and na = 1").where(F.col("sd").isNull() | F.col("sa").isNull() | (F.col("sd") == F.col("sa"))).select(*group, "detail", "appraisal")
    by = [*group, same]
    d2, a2 = d.where(F.col(same).isNotNull()).groupBy(*by).agg(F.count("*").alias("_d"), F.min("detail").alias("detail")), a.where(F.col(same).isNotNull()).groupBy(*by).agg(F.count("*").alias("_a"), F.min("appraisal").alias("appraisal"))
    pairs = d2.join(a2, by).withColumn("_pairs", F.col("_d") * F.col("_a"))
    many = sides.where("nd > 1 or na > 1").select(*group)
    lone = pairs.groupBy(*group).agg(F.sum("_pairs").alias("_all"), F.min(F.when(F.col("_pairs") == 1, F.struct("detail", "appraisal"))).alias("p")).where("_all = 1")
    return single.unionByName(lone.join(many, list(group), "left_semi").select(*group, "p.detail", "p.appraisal"))


def contained(candidates: DataFrame, accepted: DataFrame, source: str, first: str, last: str) -> DataFrame:
    """Candidates whose span lies in an accepted one of the same source. Accepted spans are reduced to those that no other holds, by a running maximum, and met as of `first`."""
    from pyspark.sql import Window as W

    w = W.partitionBy(source).orderBy(F.col(first), F.col("_side"), F.desc(last))
    both = accepted.select(source, first, last, F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id")).unionByName(candidates.select(source, first, last, F.lit(1).alias("_side"), F.col("id").cast("long").alias("id")))
    reach = F.max(F.when(F.col("_side") == 0, F.col(last))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_reach", reach).where((F.col("_side") == 1) & (F.col("_reach") >= F.col(last))).select("id")
