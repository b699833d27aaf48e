"""Frame sequences as streams: sessions under a watermark, and a latch that lives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, source: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """source, start, end and number of frames of each session; rows later than the watermark are left out."""
    by = stream.withWatermark(time, late).groupBy(source, F.session_window(time, gap).alias("s"))
    return by.agg(F.count("*").alias("frames")).select(source, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "frames")


def latch(stream: DataFrame, source: str, order: str, sets: Column, holds: Column, idle_ms: int | None = None) -> DataFrame:
    """source, order and flag, where flag is sets, or holds and the flag of the source's row before. Rows of a source must arrive in order from batch to batch.

    A source's state is one boolean; with idle_ms, that of a source without rows for so long goes, and it begins anew. Its rows of a batch come as bounded Arrow batches and are put in order together.
    """
    marked = stream.select(F.col(source).cast("string").alias("source"), F.col(order).cast("long").alias("at"), F.coalesce(sets, F.lit(False)).alias("a"), F.coalesce(holds, F.lit(False)).alias("b"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        on = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        flags = []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            on = bool(a) or (bool(b) and on)
            flags.append(on)
        state.update((on,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"source": rows["source"].to_numpy(), "at": rows["at"].to_numpy(), "flag": flags})

    return marked.groupBy("source").applyInPandasWithState(step, "source string, at long, flag boolean", "flag boolean", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
