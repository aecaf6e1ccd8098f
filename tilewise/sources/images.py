"""Image files as tables, with Spark's own file sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height`` from the headers of PNG files; others and empty images are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    sized = files.filter(F.substring("content", 1, 8) == F.lit(PNG)).select("path", number(17).alias("width"), number(21).alias("height"))
    return sized.filter("width > 0 AND height > 0")


#: Rows of an image that leave a task together, and the channels of each mode.
BLOCK = 256
MODES = {"RGB": 3, "L": 1}
#: Shares of red, green and blue in grey, of 65,536.
GREY = (19_595, 38_470, 7_471)


def decoded(data: bytes, height: int, width: int, channels: int, mode: str | None) -> np.ndarray:
    """``channel, y, x`` of an image stored row by row, blue first; alpha is left out.

    ``mode``: RGB repeats grey three times, L mixes colours to grey; None takes what is there.
    """
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3].transpose(2, 0, 1)[::-1]
    if mode == "RGB" and len(a) == 1:
        return np.repeat(a, 3, axis=0)
    if mode == "L" and len(a) == 3:
        return (np.tensordot(np.array(GREY), a.astype(np.int64), 1) + 0x8000 >> 16).astype(np.uint8)[None]
    return a


def _rows(batches: Iterator[pa.RecordBatch], mode: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, height, width, channels, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a = decoded(data, height, width, channels, mode)
            if mode and len(a) != MODES[mode]:
                raise ValueError(f"{path} is no {mode} image: it has {len(a)} channels")
            for c in range(len(a)):
                for y in range(0, height, BLOCK):
                    part = a[c, y : y + BLOCK]
                    n = len(part)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(part.ravel().astype(np.int16)))
                    columns = [pa.array([path] * n), *(pa.array(np.full(n, v, np.int32)) for v in (width, height)), pa.array(np.arange(y, y + n, dtype=np.int32)), pa.array(np.full(n, c, np.int32)), rows]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "width", "height", "y", "channel", "row"])


def image_rows(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """``path, width, height, y, channel, row``: decoded images, a row of one channel at a time.

    ``mode``: ``RGB`` for images, ``L`` for masks, as the other operators expect them; images of
    other kinds are converted. Undecodable files are left out.
    """
    if mode is not None and mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    i = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")
    return i.select("origin", "height", "width", "nChannels", "data").mapInArrow(partial(_rows, mode=mode), "path string, width int, height int, y int, channel int, row array<short>")


def pixels(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """``path, y, x, channel, v``: the pixels of ``image_rows``; channels are red, green, blue."""
    cells = image_rows(spark, path, mode).select("path", "y", "channel", F.posexplode("row").alias("x", "v"))
    return cells.select("path", "y", "x", "channel", F.col("v").cast("int").alias("v"))
