"""Frames of several sources as one table, by a data source of Spark: a task for each source, and a row for what failed.

`spark.read.format("orrery_frames").option("paths", json).load()` after `register(spark)`; json is a list of files. A `.jsonl` file gives a row for each usable line, and one with its
reason for every other that isn't blank; a `.png`, `.jpg` or `.jpeg` file is one frame; any other kind, and a source that can't be read, is one row with its error. Sources that fail leave the
others whole. Rows are source_file, source_type, frame_path, frame_index, timestamp_s, payload (the line) and error, null where there is none.
Files are read through pyarrow's file systems, in batches of bounded rows; a path needs a scheme unless it is one that all executors see.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.sources.records import IMAGES, RECORDS

SCHEMA = "source_file string, source_type string, frame_path string, frame_index long, timestamp_s double, payload string, error string"
#: Rows in a batch.
BATCH = 5_000


def _whole(value: object) -> int:
    try:
        return 0 if value is None or isinstance(value, bool) else int(float(value))
    except (TypeError, ValueError, OverflowError):
        return 0


def _number(value: object) -> float:
    try:
        return 0.0 if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return 0.0


def _line(name: str, text: str) -> tuple | None:
    """The row of a line; None for a blank one."""
    if not text.strip():
        return None
    bad = lambda why: (name, "frames_jsonl", None, None, None, text, why)
    try:
        value = json.loads(text)
    except ValueError:
        return bad("invalid JSON")
    if not isinstance(value, dict):
        return bad("expected a JSON object")
    path = value.get("frame_path")
    path = path.strip() if isinstance(path, str) else ""
    if not path:
        return bad("missing frame_path")
    if posixpath.splitext(path)[1].lower().lstrip(".") not in IMAGES:
        return bad("unsupported image type")
    source, kind = value.get("source_file"), value.get("source_type")
    return (source if isinstance(source, str) and source else name, kind if isinstance(kind, str) and kind else "image", path, _whole(value.get("frame_index")), _number(value.get("timestamp_s")), text, None)


def _rows(path: str) -> Iterator[tuple]:
    from pyarrow import fs

    name, kind = posixpath.basename(path), posixpath.splitext(path)[1].lower().lstrip(".")
    system, place = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    if kind in IMAGES:
        if system.get_file_info(place).type != fs.FileType.File:
            raise FileNotFoundError(path)
        yield (name, "image", path, 0, 0.0, None, None)
    elif kind == RECORDS:
        with system.open_input_stream(place) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from filter(None, (_line(name, x.decode("utf-8", "replace")) for x in lines))
            if row := _line(name, rest.decode("utf-8", "replace")):
                yield row
    else:
        raise ValueError(f"unsupported source type: {kind or 'none'}")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]
        batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        held: list[tuple] = []
        if partition is None:  # of no sources at all
            return
        try:
            for row in _rows(partition.value):
                held.append(row)
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        except Exception as error:  # a source's failure is a row of the result
            held.append((posixpath.basename(partition.value), None, None, None, None, None, f"{type(error).__name__}: {error}"))
        if held:
            yield batch(held)


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("paths", "[]")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)


def collect(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The frames of all sources, and what went wrong: source_file, payload and error."""
    register(spark)
    rows = spark.read.format("orrery_frames").option("paths", json.dumps(paths)).load()
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("source_file", "payload", "error")
