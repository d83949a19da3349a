"""Rank statistics and selectivity of gates: Spearman, AUC, refused shares, size bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .curves import coverage_targets
from .ranking import find_splits, quantiles, running, take_at


def spearman(rows: DataFrame, by: list[str], a: str, b: str, ident: str = "id") -> DataFrame:
    """Pearson correlation of ordinal ranks; 0 when a rank is constant. Columns ``by`` and ``rho``."""
    by = list(by)
    ranked = running(rows.select(*by, a, b, ident), [a, ident], by, rank="_ra")
    ranked = running(ranked, [b, ident], by, rank="_rb")
    n, ra, rb = F.count(F.lit(1)), F.col("_ra").cast("double"), F.col("_rb").cast("double")
    return ranked.groupBy(*by).agg(F.when(n > 1, F.corr(ra, rb)).otherwise(F.lit(0.0)).alias("rho"))


def auc(rows: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """Probability that a positive ranks above a negative, ties counted half. Columns ``by`` and ``auc``.

    Rows are counted per distinct value first, so ties cost nothing.
    """
    by = list(by)
    counted = rows.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col(positive).cast("bigint")).alias("_p"))
    ranked = running(counted, [value], by, rank="_top", weight="_c")
    mid = F.col("_top") - (F.col("_c") - 1) / 2
    pos, neg = F.sum("_p").cast("double"), F.sum(F.col("_c") - F.col("_p")).cast("double")
    return ranked.groupBy(*by).agg(
        ((F.sum(F.col("_p") * mid) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def edges(rows: DataFrame, value: str, bands: int) -> list[float]:
    """Inner quantile edges for equal-count bands; a handful of numbers."""
    probs = [i / bands for i in range(1, bands)]
    got = quantiles(rows, [], value, probs).collect()
    return [r["value"] for r in sorted(got, key=lambda r: r["prob"])]


def band(value: Column, at: list[float]) -> Column:
    """Index of the band: how many edges are at or below the value."""
    return reduce(lambda acc, e: acc + (value >= F.lit(float(e))).cast("int"), at, F.lit(0))


def selectivity(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score", ident: str = "id",
                coverages=(0.9, 0.5), big: float = 400.0, small: float = 100.0,
                strata: list[str] = ()) -> DataFrame:
    """Mean truth of the kept rows and the shares of big and small rows that are refused.

    All three come from prefix sums at the kept rank, so no row is flagged and no second pass is needed.
    """
    by, keys = list(by), list(by) + list(strata)
    rows = rows.select(*keys, score, ident, F.col(truth).cast("double").alias("_t"),
                       (F.col(truth) > big).cast("double").alias("_big"),
                       (F.col(truth) < small).cast("double").alias("_small"))
    splits = find_splits(rows, by, [score, ident])
    kept = take_at(rows, keys, [score, ident], coverage_targets(coverages),
                   {"t": "_t", "big": "_big", "small": "_small"}, splits=splits)
    kept = kept.groupBy(*by, "coverage").agg(*[F.sum(c).alias(c) for c in ("k", "t", "big", "small")])
    totals = rows.groupBy(*by).agg(F.sum("_big").alias("_bt"), F.sum("_small").alias("_st"))
    joined = kept.join(totals, by) if by else kept.join(totals)
    refused = lambda part, whole: (F.col(whole) - F.col(part)) / F.greatest(F.col(whole), F.lit(1.0))
    return joined.select(*by, "coverage", (F.col("t") / F.col("k")).alias("kept_mean"),
                         refused("big", "_bt").alias("big_refused"),
                         refused("small", "_st").alias("small_refused"))
