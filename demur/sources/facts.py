"""Fact and summary tables: typed read-back, text export, incremental cache, key merge, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import DoubleType, FloatType, StructType

from demur.functions.expr import significant


def read_fact(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV fact; an empty typed table when there is no file yet."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def export_text(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with fractional columns at a fixed number of significant digits."""
    cols = [significant(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema]
    df.select(*cols).write.csv(path, header=True)


def complete_cache(cached: DataFrame, wanted: DataFrame, compute, key: str = "id") -> DataFrame:
    """Cached rows plus computed rows for the wanted keys that are missing; nothing is computed twice."""
    todo = wanted.join(cached.select(key), key, "left_anti")
    return cached.unionByName(compute(todo))


def write_cache(df: DataFrame, path: str, key: str = "id") -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def merge_keys(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Existing summary with the rows of the fresh keys replaced."""
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def as_json(df: DataFrame, keys: list[str], name: str = "summary") -> DataFrame:
    """One JSON text per row of keys, from the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
