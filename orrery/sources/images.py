"""Pictures of image files, by Spark's image reader.

Each file is a source of one frame. Pixels come as red, green and blue; grey pictures get three equal channels, transparency goes. A file that is no picture is a row without pixels, which
`operators.pictures` tells with its reason. Files are decoded by the executors, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PICTURES = "source_file string, frame_index long, frame_path string, width int, height int, pixels binary"


def _rgb(data: bytes, width: int, height: int, channels: int) -> bytes | None:
    if width < 1 or height < 1 or channels not in (1, 3, 4) or len(data) != width * height * channels:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(pixels, 3, 2) if channels == 1 else pixels[..., 2::-1]).tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """PICTURES of the image files below a path. The name of a source is that of its file."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, widths, heights, channels = (batch.column(c).to_pylist() for c in ("origin", "width", "height", "nChannels"))
            data = batch.column("data")
            for i, (p, w, h, n) in enumerate(zip(paths, widths, heights, channels, strict=True)):
                pixels = _rgb(data[i].as_py() or b"", w or 0, h or 0, n or 0)
                row = [p.rsplit("/", 1)[-1], 0, p, w if pixels else None, h if pixels else None, pixels]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], ["source_file", "frame_index", "frame_path", "width", "height", "pixels"])

    return found.select("origin", "width", "height", "nChannels", F.col("data")).mapInArrow(run, PICTURES)
