"""Images in and out. Pixels stay in their rows; every transform drops them as early as it can."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.functions.strings import data_url
from vellumetry.operators.model import MEDIA_TYPES

GLOB = "*.{" + ",".join([*MEDIA_TYPES, *(m.upper() for m in MEDIA_TYPES)]) + "}"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data, error) of all files; data is rows of BGR bytes. Unreadable files have an error, the job goes on."""
    rows = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", GLOB).option("recursiveFileLookup", True).load(path)
    bad = F.col("image.height") <= 0
    return rows.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.when(~bad, F.col("image.data")).alias("data"),
        F.when(bad, "cannot read image").alias("error"),
    )


def landing(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as a stream of (path, modificationTime, length, content); a folder without any is an empty stream."""
    files = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(files).option("pathGlobFilter", GLOB).load(path)


def data_urls(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path)
    return files.select("path", data_url(F.col("content"), F.col("path")).alias("url"))


def pixels(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def png(image: np.ndarray) -> bytes:
    """An RGB or grey array as PNG; lossless, unlike crops kept as JPEG."""
    height, width = image.shape[:2]
    colour = 2 if image.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def written(folder: str, name: str, content: bytes) -> str:
    """Writes a file into a folder of any file system pyarrow knows, and gives its path. Written anew if it is there."""
    files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base.rstrip('/')}/{name}") as out:
        out.write(content)
    return f"{folder.rstrip('/')}/{name}"
