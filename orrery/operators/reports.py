"""Reports of a run: what took how long, what was asked of frames, what became of them. All are aggregations; tops are limits of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operations(frames: DataFrame, most: int = 12) -> DataFrame:
    """operation, total_s, frames, mean_s and share of all (in per cent, three digits) of the slowest operations. timing: a map from operation to seconds."""
    spread = frames.select(F.explode("timing").alias("operation", "s"))
    whole = spread.agg(F.sum("s").alias("whole"))
    found = spread.groupBy("operation").agg(F.sum("s").alias("total_s"), F.count("*").alias("frames"), F.avg("s").alias("mean_s")).crossJoin(F.broadcast(whole))  # one row
    return found.select("operation", F.round("total_s", 6).alias("total_s"), "frames", F.round("mean_s", 6).alias("mean_s"), F.round(F.when(F.col("whole") > 0, 100 * F.col("total_s") / F.col("whole")).otherwise(0.0), 3).alias("share")).orderBy(F.desc("total_s"), "operation").limit(most)


def _total() -> Column:
    return F.round(F.aggregate(F.map_values("timing"), F.lit(0.0), lambda a, x: a + x), 6)


def slowest_frames(frames: DataFrame, most: int = 10) -> DataFrame:
    return frames.select("source_file", "frame_index", _total().alias("total_s")).orderBy(F.desc("total_s"), "source_file", "frame_index").limit(most)


def slowest_sequences(frames: DataFrame, most: int = 10) -> DataFrame:
    by = frames.where("seq is not null").groupBy("source_file", "seq").agg(F.round(F.sum(_total()), 6).alias("total_s"), F.count("*").alias("frames"), F.min("frame_index").alias("first_frame_index"))
    return by.orderBy(F.desc("total_s"), "source_file", "first_frame_index").limit(most)


def asked_groups(results: DataFrame, most: int = 20) -> DataFrame:
    """fields, n: which fields were asked of frames together, most often first. results: read, as of production.scan."""
    asked = results.select(F.explode("read").alias("r")).select(F.array_join("r.fields", ",").alias("fields"))
    return asked.groupBy("fields").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fields").limit(most)


def lifecycle(events: DataFrame) -> DataFrame:
    """action, reason, n: events by action (reason null), and by action and reason."""
    return events.groupingSets([[F.col("action")], [F.col("action"), F.col("reason")]], "action", "reason").agg(F.count("*").alias("n"))


def workers(events: DataFrame) -> DataFrame:
    """phase, batches, retries, most workers, items and failures. events: phase, attempt, workers, items, failed."""
    return events.groupBy("phase").agg(F.count("*").alias("batches"), F.count_if(F.col("attempt") > 1).alias("retries"), F.max("workers").alias("most_workers"), F.sum("items").alias("items"), F.sum("failed").alias("failed"))


def profile(frames: DataFrame, phases: dict[str, float], run_total_s: float) -> dict:
    """Frames by class, phases with their share of the run, and the slowest operations."""
    classes = {r["classification"]: r["n"] for r in frames.groupBy("classification").agg(F.count("*").alias("n")).orderBy("classification").collect()}  # a handful of classes
    share = lambda s: round(100 * s / run_total_s, 3) if run_total_s > 0 else 0.0
    return {"run_total_s": round(run_total_s, 6), "classes": classes, "phases": {k: {"s": round(v, 6), "share": share(v)} for k, v in phases.items()}, "operations": [r.asDict() for r in operations(frames).collect()]}


def sources(frames: DataFrame) -> DataFrame:
    """Frames, classes and the span of each source."""
    return frames.groupBy("source_file").agg(F.count("*").alias("frames"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), *[F.count_if(F.col("classification") == c).alias(c) for c in ("list", "detail", "appraisal", "non_extractable")])
