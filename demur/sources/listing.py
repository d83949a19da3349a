"""Object listings: availability, roll-up and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def roll_up(objects: DataFrame, name: str = "name", size: str = "size", id_part: int = 4,
            file_part: int = 5, order: str | None = None) -> DataFrame:
    """Object names split on ``/`` into one row per (id, file) with its size; short names are skipped.

    Positions are 1-based. A name listed twice keeps the size last in ``order``, or the largest without an order. The nested per-id map is left to the
    sink: as rows it has no size limit.
    """
    parts = F.split(F.col(name), "/")
    at = F.col(size) if order is None else F.col(order)
    kept = objects.select(parts.alias("p"), F.col(size).alias("size"), at.alias("_at")).filter(F.size("p") >= 5)
    return kept.groupBy(F.element_at("p", id_part).alias("id"), F.element_at("p", file_part).alias("file")).agg(
        F.max_by("size", "_at").alias("size"))


def total_bytes(manifest: DataFrame, file: str) -> DataFrame:
    """Number and total size of the objects with one file name."""
    return manifest.filter(F.col("file") == file).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"id": .., "files": {name: bytes}}`` as rows (id, file, size)."""
    raw = spark.read.schema("id string, files map<string,bigint>").json(path)
    return raw.select("id", F.explode("files").alias("file", "size"))


def available_ids(manifest: DataFrame, file: str) -> DataFrame:
    return manifest.filter(F.col("file") == file).select("id").distinct()


def local_ids(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """Ids (folder names) that hold a file. Only paths are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", file).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("id")).distinct()


def reconcile(expected: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """Status of every expected file: ``skip`` if it is there with the right (or unknown) size, ``fetch`` if it
    is missing, ``FAIL`` if the size differs, ``extra`` if nobody expects it."""
    joined = expected.select(key, F.col("size").alias("expected"), F.lit(True).alias("_wanted")).join(
        present.select(key, F.col("size").alias("present"), F.lit(True).alias("_there")), key, "full_outer")
    status = (F.when(F.col("_there").isNull(), "fetch").when(F.col("_wanted").isNull(), "extra")
              .when(F.col("expected").isNull() | (F.col("expected") == 0) | (F.col("expected") == F.col("present")), "skip").otherwise("FAIL"))
    return joined.withColumn("status", status).drop("_wanted", "_there")
