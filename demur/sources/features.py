"""Feature tables partitioned by model, split and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_features(features: DataFrame, path: str) -> None:
    features.write.partitionBy("model", "split", "condition").parquet(path)


def read_features(spark: SparkSession, path: str, model: str, split: str, condition: str) -> DataFrame:
    """One partition; the filters prune folders before anything is read."""
    return spark.read.parquet(path).filter(
        (F.col("model") == model) & (F.col("split") == split) & (F.col("condition") == condition))


def with_fallback(wanted: DataFrame, features: DataFrame, split: str, fallback: str = "train",
                  key: str = "id") -> DataFrame:
    """Features of the wanted ids from ``split``, else from the fallback split. Adds ``source``.

    ``features`` has columns key, ``split`` and ``features``. A test split has no fallback, and its absence is an error.
    """
    if split == "test" and not features.filter(F.col("split") == split).limit(1).count():
        raise FileNotFoundError("no features of the test split")
    own = features.filter(F.col("split") == split).select(key, F.col("features").alias("_own"))
    if split == "test":
        return wanted.join(own, key).select(*wanted.columns, F.col("_own").alias("features"), F.lit(split).alias("source"))
    other = features.filter(F.col("split") == fallback).select(key, F.col("features").alias("_other"))
    both = wanted.join(own, key, "left").join(other, key, "left")
    found = both.filter(F.col("_own").isNotNull() | F.col("_other").isNotNull())
    return found.select(*wanted.columns, F.coalesce("_own", "_other").alias("features"),
                        F.when(F.col("_own").isNotNull(), split).otherwise(fallback).alias("source"))


def require_all(wanted: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Inner gather that fails when a wanted id has no row."""
    missing = wanted.select(key).join(found.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise KeyError("wanted ids without feature rows")
    return wanted.join(found, key)


def pool_tokens(tokens: DataFrame, ident: str = "id", prefix: int = 1) -> DataFrame:
    """``[first token ; mean of patches ; sample sd of patches]`` per id from rows (id, token, dim, v)."""
    patch = F.when(F.col("token") >= prefix, F.col("v"))
    first = F.max(F.when(F.col("token") == 0, F.col("v"))) if prefix else F.avg("v")
    per_dim = tokens.groupBy(ident, "dim").agg(
        first.alias("first"), F.avg(patch).alias("mean"), F.stddev_samp(patch).alias("sd"))
    return per_dim


def assemble(pooled: DataFrame, ident: str = "id") -> DataFrame:
    """Feature arrays from pooled rows; an array has three values per dimension, so it is small."""
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda s: s[c])
    return pooled.groupBy(ident).agg(F.concat(part("first"), part("mean"), part("sd")).alias("features"))
