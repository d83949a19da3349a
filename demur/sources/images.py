"""Image files: a scan with Spark's image source, and a writer of small PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_images(spark: SparkSession, path: str, id_part: int = -2) -> DataFrame:
    """Columns id (a path part), height, width, channels, data. Channel order in ``data`` is blue, green, red."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("image.origin", "/"), id_part).alias("id"), F.col("image.height").alias("height"),
                      F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def png(height: int, width: int, data: bytes) -> bytes:
    """A PNG file of 8-bit pixels given row by row as blue, green, red."""
    rows = [data[i * width * 3:(i + 1) * width * 3] for i in range(height)]
    turned = b"".join(b"\0" + b"".join(row[j:j + 3][::-1] for j in range(0, len(row), 3)) for row in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(turned)) + chunk(b"IEND", b"")


def write_png(images: DataFrame, folder: str, name: str = "photo.png") -> None:
    """Write ``folder``/id/``name`` for every row (id, height, width, data) from the tasks; a repeated attempt writes the same bytes."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for row in batch.to_pylist():
                store.create_dir(f"{root}/{row['id']}", recursive=True)
                with store.open_output_stream(f"{root}/{row['id']}/{name}") as out:
                    out.write(png(row["height"], row["width"], row["data"]))
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    images.select("id", "height", "width", "data").mapInArrow(write, "n long").agg(F.sum("n")).collect()
