"""What becomes of the files of frames: a state for each, who may delete them, and how many there were at once.

Events have source_file, frame_index, frame_path, at (a number or time that orders them), action (`processed`, `skipped`, `deleted`, `retained`), reason and phase.
Frames pass from held (extracted) to protected (in a sequence that is still read), and to released (deleted, or absent) or retained (not ours to delete); of events at one time the one that goes further counts.
Null actions and times count for nothing. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What files of frames are called, and classes whose frames go at once.
PREFIX, MARK = "frame_", "__"
UNUSED = ("list", "non_extractable")
_ORDER = ("held", "protected", "retained", "released")


def is_ours(path: Column, root: Column | str, original: Column | None = None) -> Column:
    """Whether a file lies below the folder of extracted frames, bears their name, is no overlay and not the source itself. Paths that go up a folder are refused."""
    at, base = F.regexp_replace(path, "^file:(//)?(?=/)", ""), root if isinstance(root, Column) else F.lit(root)
    base = F.concat(F.regexp_replace(F.regexp_replace(base, "^file:(//)?(?=/)", ""), "/+$", ""), F.lit("/"))
    name = F.element_at(F.split(at, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    kept = at.startswith(base) & ~at.rlike(r"(^|/)\.\.?(/|$)") & name.startswith(PREFIX) & ~stem.contains(MARK)
    if original is not None:
        kept = kept & ~F.coalesce(at == F.regexp_replace(original, "^file:(//)?(?=/)", ""), F.lit(False))
    return F.coalesce(kept, F.lit(False))


def states(events: DataFrame) -> DataFrame:
    """state, at and reason of each frame that has an event which tells."""
    action, reason = F.col("action"), F.coalesce("reason", F.lit(""))
    gone = (action == "deleted") | ((action == "skipped") & reason.endswith("already_absent"))
    state = F.when(gone, "released").when(action == "retained", "retained").when((action == "processed") & (reason == "extracted"), "held").when(action == "processed", "protected")
    told = events.withColumn("state", state).where("state IS NOT NULL AND at IS NOT NULL").withColumn("rank", F.array_position(F.array(*map(F.lit, _ORDER)), F.col("state")))
    last = told.groupBy("source_file", "frame_index").agg(F.max(F.struct("at", "rank", F.coalesce("reason", F.lit("")).alias("reason"), "state")).alias("x"))
    return last.select("source_file", "frame_index", "x.state", "x.at", F.col("x.reason").alias("reason"))


def _change() -> Column:
    action = F.col("action")
    return F.when((action == "processed") & (F.col("reason") == "extracted"), 1).when(action == "deleted", -1).otherwise(0)


def peaks(events: DataFrame, limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """source_file, peak and exceeded: the most files that a source had at once, and whether that is above the limit.

    Events are dealt by ranges of (source, time), not by source: each range adds up its own changes and finds its highest sum, and one row a source and range is put together after that.
    Of events at one time, extractions come first.
    """
    spark = events.sparkSession
    n = tasks or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    changes = events.select(F.col("source_file").cast("string"), "at", _change().alias("d")).where("d <> 0 AND at IS NOT NULL")
    ranged = changes.repartitionByRange(n, "source_file", "at", F.desc("d")).sortWithinPartitions("source_file", "at", F.desc("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, name, total, most, some = TaskContext.get().partitionId(), None, 0, 0, False
        sort = pa.string()
        row = lambda: pa.record_batch([pa.array([name], sort), *(pa.array([x], pa.int64()) for x in (task, total, most))], ["source_file", "task", "total", "most"])
        for batch in batches:
            if not batch.num_rows:
                continue
            names, change = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            borders = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(borders, borders[1:]):
                if some and names[a] != name:
                    yield row()
                    total, most = 0, 0
                name, some = names[a], True
                sums = total + np.cumsum(change[a:b])
                total, most = int(sums[-1]), max(most, int(sums.max()))
        if some:
            yield row()

    parts = ranged.mapInArrow(run, "source_file string, task long, total long, most long")
    before = F.coalesce(F.sum("total").over(W.partitionBy("source_file").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = parts.withColumn("most", F.col("most") + before).groupBy("source_file").agg(F.greatest(F.lit(0), F.max("most")).alias("peak"))
    return found.withColumn("exceeded", F.col("peak") > limit if limit is not None else F.lit(False))


def limit_warnings(peaks_: DataFrame, limit: int) -> DataFrame:
    """source_file and message of the sources that went above the limit."""
    text = F.concat(F.lit("Temporary export frame file count reached "), F.col("peak").cast("string"), F.lit(f", above the configured soft limit of {limit}; kept needed frames to preserve correctness."))
    return peaks_.where(F.col("peak") > limit).select("source_file", text.alias("message"))


def release(frames: DataFrame, root: str, reason: Column) -> DataFrame:
    """Deletes the files of frames (source_file, frame_index, frame_path and perhaps source_path) on the executors, where they are ours, and tells it as events without a time.

    A file that is gone already is `skipped`, one that isn't ours and exists is `retained`: a second run deletes nothing and fails at nothing. The folder must be one that all executors see. Nothing happens before the result is computed.
    """
    original = F.col("source_path") if "source_path" in frames.columns else None
    asked = frames.select("source_file", "frame_index", "frame_path", is_ours(F.col("frame_path"), root, original).alias("ours"), reason.alias("reason")).dropDuplicates(["frame_path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            actions, reasons = [], []
            for path, ours, why in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                local = (path or "").removeprefix("file://").removeprefix("file:")
                if not ours:
                    actions.append("retained" if os.path.isfile(local) else "skipped")
                    reasons.append("unsafe_or_non_export_frame_path")
                    continue
                try:
                    # The real place counts, too: a link below the folder may lead out of it.
                    base = os.path.realpath(root.removeprefix("file://").removeprefix("file:"))
                    if os.path.exists(local) and not os.path.realpath(local).startswith(base + os.sep):
                        actions.append("retained")
                        reasons.append("unsafe_or_non_export_frame_path")
                        continue
                    os.unlink(local)
                    actions.append("deleted")
                    reasons.append(why)
                except FileNotFoundError:
                    actions.append("skipped")
                    reasons.append(f"{why}:already_absent")
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(actions, pa.string()), pa.array(reasons, pa.string()), pa.array(["cleanup"] * len(actions))], ["source_file", "frame_index", "frame_path", "action", "reason", "phase"])

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("source_file", "frame_index", "frame_path"))
    return asked.mapInArrow(run, f"{kinds}, action string, reason string, phase string")


def unused(frames: DataFrame) -> DataFrame:
    """Frames whose class is never read, with the reason for which they go."""
    return frames.where(F.col("raw_classification").isin(*UNUSED)).withColumn("reason", F.concat(F.lit("classified:"), F.col("raw_classification")))


def append_batch(events: DataFrame, folder: str, batch: int) -> None:
    """Writes a micro-batch's events under its number, in place of what an earlier run of it wrote; for foreachBatch."""
    events.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
