"""Sequences of frames released from a stream as they end, with state that goes when they do.

Frames of a source may come in any order within the watermark. Those that it has passed are final; they are taken in the order of time and frame_index, whatever
batches they came in, so that any cut of the stream gives the rows of `closed`, the same over a table. A sequence is a run of members of one kind; others, frames in transition
and pauses longer than `pause` end it. The state of a source is its waiting frames, the frames of its open sequence and one row about that; a timer at the
pause after the last frame releases it, and nothing stays. Frames later than the watermark are left out, as are those without a source or time. Repeated frames count each.
Streams need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orrery.operators import production, sequences

RELEASED = "source_file string, raw_classification string, first_index long, last_index long, frames long, frame_indexes array<long>"
_WAITING = "at long, frame_index long, kind string, sets boolean, holds boolean"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def marked(frames: DataFrame, time: str) -> DataFrame:
    """source_file, ts, at (milliseconds), frame_index, kind (the class of a member, else null), sets and holds (of transitions) of classed frames with their motion."""
    sets, holds = production.transition_rules()
    kind = F.when(production.is_candidate(), F.col("raw_classification"))
    at = F.unix_millis(F.col(time).cast("timestamp"))
    out = frames.select(F.col("source_file").cast("string"), F.col(time).cast("timestamp").alias("ts"), at.alias("at"), F.col("frame_index").cast("long"), kind.alias("kind"), F.coalesce(sets, F.lit(False)).alias("sets"), F.coalesce(holds, F.lit(False)).alias("holds"))
    return out.where("source_file IS NOT NULL AND ts IS NOT NULL")


def closed(frames: DataFrame, time: str = "ts", pause_ms: int = 5000) -> DataFrame:
    """RELEASED rows of all sequences of a table."""
    part, order = ["source_file"], ["at", "frame_index"]
    on = sequences.latch(marked(frames, time), part, order, F.col("sets"), F.col("holds"), "moving")
    w = W.partitionBy(*part).orderBy(*order)
    paused = on.withColumn("breaks", F.coalesce(F.col("at") - F.lag("at").over(w) > pause_ms, F.lit(False)))
    paused = paused.withColumn("stretch", F.sum(F.col("breaks").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    member = F.col("kind").isNotNull() & ~F.col("moving")
    runs = sequences.with_runs(paused, part, order, member, F.struct("kind", "stretch"), "seq").where("seq IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("at", "frame_index")))
    found = runs.groupBy("source_file", "seq", F.col("kind").alias("raw_classification")).agg(F.transform(listed, lambda x: x["frame_index"]).alias("frame_indexes"))
    return found.select("source_file", "raw_classification", F.element_at("frame_indexes", 1).alias("first_index"), F.element_at("frame_indexes", -1).alias("last_index"), F.size("frame_indexes").cast("long").alias("frames"), "frame_indexes")


class _Release(StatefulProcessor):
    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getListState("open", "frame_index long")
        self.about = handle.getValueState("about", "kind string, last long, moving boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for part in rows:
            if len(part):
                self.waiting.appendList([(int(a), int(i), None if k is None or k != k else str(k), bool(s), bool(h)) for a, i, k, s, h in zip(part["at"], part["frame_index"], part["kind"], part["sets"], part["holds"], strict=True)])
                latest = max(latest or 0, int(part["at"].max()))
        if latest is not None:
            self.handle.registerTimer(latest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        ready = sorted((x for x in waiting if x[0] <= until), key=lambda x: (x[0], x[1]))
        kind, last, moving = self.about.get() if self.about.exists() else (None, None, False)
        held = [int(x[0]) for x in self.open.get()] if self.open.exists() else []
        kept, out = len(held), []

        def release() -> None:
            nonlocal held, kept
            if held:
                out.append((key[0], kind, held[0], held[-1], len(held), held))
            held, kept = [], 0

        for at, index, sort, sets, holds in ready:
            moving = sets or (holds and moving)
            if moving or sort is None or sort != kind or (last is not None and at - last > self.pause_ms):
                release()
            kind, last = (None if moving else sort), at
            if kind is not None:
                held.append(index)
        if len(ready) < len(waiting):
            self.waiting.put([x for x in waiting if x[0] > until])
        elif waiting:
            self.waiting.clear()
        if last is not None and last + self.pause_ms < until:
            release()
            # The latch of a transition outlives a pause, as it does over a table; a row of two words is all that stays of it.
            kind = None
        if held:
            if kept == 0:
                self.open.put([(i,) for i in held])
            elif len(held) > kept:
                self.open.appendList([(i,) for i in held[kept:]])
            self.handle.registerTimer(last + self.pause_ms + 1)
        else:
            self.open.clear()
        if held or moving or len(ready) < len(waiting):
            self.about.update((kind, last, moving))
        else:
            self.about.clear()
        if out:
            yield pd.DataFrame(out, columns=["source_file", "raw_classification", "first_index", "last_index", "frames", "frame_indexes"])

    def close(self) -> None:
        pass


def released(stream: DataFrame, time: str = "ts", pause_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """RELEASED rows, each once its sequence has ended for good."""
    frames = marked(stream, time).withWatermark("ts", late)
    return frames.groupBy("source_file").transformWithStateInPandas(statefulProcessor=_Release(pause_ms), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")
