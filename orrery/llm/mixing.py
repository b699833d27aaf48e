"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

A source's share of the mix is proportional to its weight, and at most `max_epochs` times its size; what a clamped source
leaves is dealt to the others by weight until none is above its cap. Sorted by cap over weight, the sources that end
up clamped come first, so prefix sums give the level at which the redistribution comes to rest.

Each document is taken floor(epochs) times whole. For the rest of the target the documents of a source are taken in an order seeded by
a hash until the target is met; the last one is taken in part. Documents are ranked within hash buckets, whose
offsets come from their pre-aggregated sizes, so that no source is sorted in one task.

A null text has size 0; a null source is a source of its own, sorted last. Repeated rows each count. Sizes of 0 take 0. Empty
tables give empty results. Columns other than doc_id, text and source are ignored by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm._shared import WORD, stage

WEIGHTS = (5, 2, 1)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds target (double) to one row for each source (source, source_size). Sources are few: their windows run in one task."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # With no words a source takes nothing and holds no weight.
    ranked = ranked.withColumn("weight", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0).cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_level = W.orderBy(F.col("weight") == 0, F.col("cap") / F.nullif("weight", F.lit(0)), F.col("source").isNull(), F.col("source"))
    whole = W.partitionBy()
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", F.when(F.col("weight") > 0, (F.col("wanted") - F.col("capped_before")) / F.col("weight_left")))
    )
    # The first source, in this order, that its level leaves below its cap sets the level of all from there on.
    rest = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)
    ranked = ranked.withColumn("rest", rest["level"])
    target = F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("rest") * F.col("weight"), F.col("cap"))))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def plan(sized: DataFrame, seed: str = "mix-1", weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds source_size, target and taken to rows of doc_id, source, size; sized should be a written table, as it is read more than once.

    Other columns of sized stay, but for those of the names added and _key and _bucket.
    """
    own = [c for c in sized.columns if c not in ("source_size", "target", "taken", "_key", "_bucket")]
    keyed = sized.select(*own, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, 3))
    buckets = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("bucket_size"))
    sources = fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    offsets = buckets.withColumn("offset", F.sum("bucket_size").over(W.partitionBy("source").orderBy("_bucket")) - F.col("bucket_size"))
    placed = offsets.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("_bucket").alias("b"), "offset", "source_size", "target")
    # Within a bucket (1/4096 of a source) rows lie one after another by their key.
    end = F.sum("size").over(W.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, 0))
    ended = keyed.withColumn("_end", end)
    joined = ended.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("offset") + F.col("_end") - F.col("size"))))
    return joined.select(*own, "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix-1", weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of docs."""
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size")), "sizes")
    return plan(sized, seed, weights, share, max_epochs).select("doc_id", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, seed: str = "mix-1", weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The mixed documents: a row for each repetition, with the columns of docs; a part is the text up to its last word taken.

    n_chars, where docs has it, is that of the text returned. Column names of docs must not begin with `__or_`.
    """
    columns, row = docs.columns, F.xxhash64("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", size_of().alias("size"), row.alias("__or_row"))
    # Repeated rows are planned as one and share what it takes.
    rows = stage(sized.groupBy("doc_id", "source", "size", "__or_row").agg(F.count("*").alias("copies")).withColumn("size", F.col("size") * F.col("copies")), "sizes")
    taken = plan(rows, seed, weights, share, max_epochs).select(F.col("doc_id").alias("__or_d"), F.col("__or_row").alias("__or_r"), F.ceil(F.col("taken") / F.col("copies")).cast("long").alias("__or_take"))
    joined = docs.withColumn("__or_row", row).join(taken, (F.col("__or_row") == F.col("__or_r")) & F.col("doc_id").eqNullSafe(F.col("__or_d")))
    sized = joined.withColumn("__or_size", size_of()).where("__or_take > 0 or __or_size = 0")
    spread = sized.withColumn("__or_copy", F.explode(F.expr("CASE WHEN __or_size > 0 THEN sequence(1, cast(ceil(__or_take / __or_size) as int)) ELSE array(1) END")))
    words = F.least(F.col("__or_size"), F.col("__or_take") - (F.col("__or_copy") - 1) * F.col("__or_size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    cut = spread.withColumn("text", F.when(words >= F.col("__or_size"), F.col("text")).otherwise(first))
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])
