"""Discovery of media and record files, and a scan of JSON lines that keeps what it could not read apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Suffixes of the kinds of sources.
VIDEOS, IMAGES, RECORDS = ("mp4",), ("png", "jpg", "jpeg"), "jsonl"


def discover(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """path and source_type of the supported files of a folder and its subfolders; contents are not read. JSON lines count only as a single file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*VIDEOS), "video").when(suffix.isin(*IMAGES), "image")
    if single:
        kind = kind.when(suffix == RECORDS, "frames_jsonl")
    return found.select("path", kind.alias("source_type")).where("source_type is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted) and text, without a sort: the lines of each split are counted, then added up over the splits before it."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def _typed(name: str, kind: str, default: object) -> Column:
    """A typed member of an object; booleans are no numbers, numeric strings are."""
    at = f"$.{name}"
    raw = F.try_variant_get("v", at, "string")
    is_bool = F.schema_of_variant(F.try_variant_get("v", at, "variant")) == "BOOLEAN"
    value = raw if kind == "string" else F.when(~F.coalesce(is_bool, F.lit(False)), raw.try_cast(kind))
    return F.coalesce(value, F.lit(default).cast(kind)).alias(name)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames (file, line, frame_path, source_file, source_type, frame_index, timestamp_s, payload) and the skipped rows (file, line, reason).

    Blank lines are neither. A row is skipped if it is no JSON, no object, has no frame_path, or names an unsupported image type.
    """
    rows = numbered_lines(spark, path).where(F.trim("text") != "").withColumn("v", F.try_parse_json("text"))
    frame_path = F.trim(F.try_variant_get("v", "$.frame_path", "string"))
    suffix = F.lower(F.regexp_extract(frame_path, r"\.([^./]+)$", 1))
    reason = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "expected a JSON object")
        .when(F.coalesce(frame_path, F.lit("")) == "", "missing frame_path")
        .when(~suffix.isin(*IMAGES), "unsupported image type")
    )
    judged = rows.withColumn("reason", reason)
    fields = [_typed("source_file", "string", ""), _typed("source_type", "string", "image"), _typed("frame_index", "long", 0), _typed("timestamp_s", "double", 0.0)]
    frames = judged.where("reason is null").select("file", "line", frame_path.alias("frame_path"), *fields, F.col("v").alias("payload"))
    return frames, judged.where("reason is not null").select("file", "line", "reason")


def source_summary(frames: DataFrame) -> DataFrame:
    """Frames of each source and its first source_type."""
    return frames.groupBy("source_file").agg(F.count("*").alias("frame_count"), F.min_by("source_type", F.struct("file", "line")).alias("source_type"))


def with_timestamps(frames: DataFrame, source: str = "source_file", order: str = "frame_path", duration: str = "duration_s") -> DataFrame:
    """Adds frame_index (from 0) and timestamp_s, evenly spaced over the duration; the index itself where that is 0."""
    w = W.partitionBy(source)
    index, last = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w) - 1
    held = frames.withColumn("frame_index", index.cast("long")).withColumn("_last", F.greatest(F.lit(1), last))
    time = F.when(F.col(duration) > 0, F.col(duration) * F.col("frame_index") / F.col("_last")).otherwise(F.col("frame_index").cast("double"))
    return held.withColumn("timestamp_s", time).drop("_last")


def carry_forward(frames: DataFrame, earlier: DataFrame) -> DataFrame:
    """frames (source_file, frame_index, cp) with the valid cp of an earlier detail or appraisal row in place of their own; carried marks a change."""
    usable = earlier.where(F.col("cls").isin("detail", "appraisal") & F.col("has_cp") & F.col("cp").isNotNull())
    usable = usable.groupBy("source_file", "frame_index").agg(F.max("cp").alias("_cp"))
    joined = frames.join(usable, ["source_file", "frame_index"], "left")
    return joined.withColumn("carried", F.col("_cp").isNotNull() & ~F.col("_cp").eqNullSafe(F.col("cp"))).withColumn("cp", F.coalesce("_cp", "cp")).drop("_cp")
