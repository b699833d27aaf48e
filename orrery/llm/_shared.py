"""Helpers of the training-data operators: shared scratch tables and grouped Arrow streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, as a Java and Python pattern: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one on a local master, and an error on any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        root = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """A table written to the shared folder, so that later reads need no lineage."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/orrery/{uuid.uuid4().hex}-{label}"
        df.write.option("compression", "zstd").parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def octets(self) -> int:
        """Size of the files."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()

    def drop(self) -> None:
        """Deletes the files; only for tables that no returned DataFrame reads."""
        _remove(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def stage(df: DataFrame, label: str) -> DataFrame:
    return Staged(df, label).df


def alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make returns as a written table, without the tables that were written on the way to it."""
    before = len(_written)
    found = Staged(make(), label)
    for spark, path in _written[before:]:
        if path != found.path:
            _remove(spark, path)
    _written[before:] = [(found.spark, found.path)]
    return found.df


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def utf8(column: str) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Octets of a written table that a task of a shuffle over it takes, compressed.
_SHARE = 64 << 20


def partitions(spark: SparkSession, octets: int = 0) -> int:
    """Tasks of a shuffle over a written table of that size; at least those that the session is set to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-octets // _SHARE))


def slices(batches: Iterator[pa.RecordBatch], column: int, octets: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose text or binary column holds about so many octets, so that few Python objects live at once. Empty batches go."""
    for batch in batches:
        held = batch.column(column)
        wide = held.type in (pa.large_binary(), pa.large_string())
        ends = np.frombuffer(held.buffers()[1], np.int64 if wide else np.int32, len(held) + held.offset + 1)[held.offset :] if len(held) else np.zeros(1, np.int64)
        at = 0
        while at < len(held):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + octets, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


_state: dict[tuple, object] = {}


def of_worker(key: tuple, make: Callable):
    """What the tasks that a worker runs one after another share under a key. A worker holds one such object: another key's takes its place."""
    if key not in _state:
        _state.clear()
        pa.default_memory_pool().release_unused()
        _state[key] = make()
    return _state[key]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a partition that is sorted by key, one table each, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        if held and keys[0] != held[0].column(held[0].schema.get_field_index(key))[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at = [], i
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


#: A bitmap has so many bits at most, 64 MB.
_MOST_BITS = 29


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the longs in column h, built on the executors in slices of 4 kB: 64 for each row, or as many as are allowed. It may tell of more than was put in, never of less."""
    size = min(_MOST_BITS, max(20, (64 * hashes.count()).bit_length() - 1))
    bit = hashes.select((F.col("h").bitwiseAND(F.lit((1 << size) - 1)) + 1).alias("b"))  # values and buckets count from 1
    parts = bit.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for row in parts.toLocalIterator():
        at = (row["n"] - 1) * 4096
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[at : at + len(piece)] |= piece[: len(out) - at]
    return out


def marked_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned longs may be in a bitmap."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
