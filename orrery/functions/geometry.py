"""Boxes on a frame, as arrays of left, top, right and bottom in shares of its size, and windows in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the chips of a tag lie below the bar of hit points, and where they lie if it was not found.
TAG_SPAN, TAG_ELSEWHERE = (0.035, 0.145), (0.06, 0.44, 0.94, 0.55)


def clamped(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box inside the frame, at least a hundredth high."""
    upper = F.greatest(F.lit(0.0), F.least(F.lit(0.98), top))
    return F.array(F.greatest(F.lit(0.0), left), upper, F.least(F.lit(1.0), right), F.greatest(upper + 0.01, F.least(F.lit(1.0), bottom)))


def height(box: Column) -> Column:
    return F.greatest(F.lit(0.0), F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def tag_box(anchor: Column) -> Column:
    """Where tags are, by the height of the bar of hit points (null: unknown)."""
    return F.when(anchor.isNull(), F.array(*map(F.lit, TAG_ELSEWHERE))).otherwise(clamped(F.lit(0.06), anchor + TAG_SPAN[0], F.lit(0.94), anchor + TAG_SPAN[1]))


def distinct_boxes(boxes: Column) -> Column:
    """Boxes that differ to four digits, in their order."""
    rounded = F.transform(boxes, lambda b: F.transform(b, lambda x: F.round(x, 4)))
    return F.filter(boxes, lambda b, i: F.array_position(rounded, F.transform(b, lambda x: F.round(x, 4))) == i + 1)


def steady(times: Column) -> Column:
    """Whether the times of a video's frames are complete and strictly rise."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: F.coalesce((F.get(times, i) > F.get(times, i - 1)) | (F.size(times) == 1), F.lit(False)))
    return (F.size(times) > 0) & ~F.exists(times, lambda t: t.isNull()) & F.forall(pairs, lambda x: x)


def seek_window(times: Column, first: Column, last: Column) -> Column:
    """start_s and duration_s to seek for the frames first to last: their span and a margin on both sides, a tenth of it, between a quarter and two seconds."""
    begin, end = F.get(times, first.cast("int")), F.get(times, last.cast("int"))
    step = F.when(F.size(times) > 1, (F.get(times, F.size(times) - 1) - F.get(times, F.lit(0))) / (F.size(times) - 1)).otherwise(0.0)
    margin = F.greatest(F.lit(0.25), F.least(F.lit(2.0), 0.1 * (end - begin)))
    start = F.greatest(F.lit(0.0), begin - margin)
    return F.struct(start.alias("start_s"), (end + step + margin - start).alias("duration_s"))


def chunk_size(limit: Column, held: Column, first: Column) -> Column:
    """How many frames to extract next: the limit at first, then a fifth of it, but no more than there is room for; at least one."""
    wanted = F.when(first, limit).otherwise(F.greatest(F.lit(1), F.floor(limit / 5)))
    return F.greatest(F.lit(1), F.least(wanted, limit - held)).cast("long")
