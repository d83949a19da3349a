"""Gap sessions: a new session starts when the gap to the previous row is strictly above a limit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import find_splits, running, with_bucket

# Fixed value: the session gap in seconds.
SESSION_GAP_S = 600.0


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def with_gap(df: DataFrame, at: str, ident: str, keys: list[str] = (), name: str = "gap",
             rows_per_bucket: int | None = None) -> DataFrame:
    """Add the distance of ``at`` (a number) to the previous row of the same key, null on the first row.

    Keys that hold very many rows are cut into ordered buckets; the first row of a bucket looks at the
    largest value of the buckets before it.
    """
    keys, order = list(keys), [at, ident]
    splits = find_splits(df, keys, order, rows_per_bucket)
    if splits is None:
        previous = F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, F.col(at) - previous)
    rows = with_bucket(df, keys, order, splits)
    lasts = rows.groupBy(*keys, "__bucket").agg(F.max(at).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*keys, "__bucket", F.max("_top").over(before).alias("_before"))
    rows = rows.join(lasts, keys + ["__bucket"])
    previous = F.lag(at).over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    return rows.withColumn(name, F.col(at) - F.coalesce(previous, "_before")).drop("__bucket", "_before")


def sessionize(df: DataFrame, at: str, ident: str, keys: list[str] = (), gap: float = SESSION_GAP_S,
               name: str = "session", rows_per_bucket: int | None = None) -> DataFrame:
    """Add the session index from 0 inside each key, in the order (``at``, ``ident``)."""
    flagged = with_gap(df, at, ident, keys, "_gap", rows_per_bucket)
    flagged = flagged.withColumn("_new", F.coalesce((F.col("_gap") > gap).cast("bigint"), F.lit(0).cast("bigint")))
    out = running(flagged, [at, ident], keys, sums={name: "_new"}, rank="_rank", rows_per_bucket=rows_per_bucket)
    return out.withColumn(name, F.col(name).cast("bigint")).drop("_gap", "_new", "_rank")


def gap_histogram(gaps: DataFrame, gap: str = "gap", top: float = 6.5, edges: int = 40) -> DataFrame:
    """Counts of positive gaps on log10 bins from 1 to ``10^top``; the last bin includes its upper edge."""
    place = F.floor(F.log10(F.col(gap)) / F.lit(top / (edges - 1))).cast("int")
    kept = gaps.filter((F.col(gap) >= 1) & (F.col(gap) <= math.pow(10.0, top)))
    return kept.groupBy(F.least(place, F.lit(edges - 2)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
