"""Cluster bootstrap without copying rows: a replicate is a multiplicity per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demur.functions.draws import uniform

from .draws import RANKED, Draws, correlations, means
from .ranking import _null_safe, running
from .replicate import spearman_by_replicate
from .splits import SEED


def multiplicities(rows: DataFrame, replicates: int, cluster: str = "cluster", seed: int = SEED,
                   with_point: bool = False) -> DataFrame:
    """How often each replicate draws each cluster: columns ``b``, ``cluster``, ``m``.

    Every replicate draws as many clusters as there are, with replacement. ``with_point`` adds replicate 0,
    where every cluster counts once, so a plan keyed by ``b`` gives point estimates and replicates together. Rows with
    a null cluster are one cluster, here and in the joins that use the result.
    """
    spark = rows.sparkSession
    clusters = running(rows.select(cluster).distinct(), [cluster], rank="_r").select(
        cluster, (F.col("_r") - 1).alias("_ord"))
    count = clusters.count()
    draws = spark.range(replicates * count).select(
        (F.floor(F.col("id") / count) + 1).cast("int").alias("b"), (F.col("id") % count).alias("_j"))
    draws = draws.select("b", F.floor(uniform("boot", seed, F.col("b"), F.col("_j")) * count).alias("_ord"))
    counted = draws.groupBy("b", "_ord").agg(F.count(F.lit(1)).alias("m"))
    out = counted.join(clusters, "_ord").select("b", cluster, "m")
    if with_point:
        point = clusters.select(F.lit(0).alias("b"), cluster, F.lit(1).cast("bigint").alias("m"))
        out = out.unionByName(point)
    return out


def interval(value: str, level: float = 0.95) -> list[Column]:
    """Percentile interval over replicates, as aggregates ``lo`` and ``hi``. A group holds B values."""
    tail = (1 - level) / 2
    return [F.percentile(value, F.lit(tail)).alias("lo"), F.percentile(value, F.lit(1 - tail)).alias("hi")]


def replicate_means(rows: DataFrame, mult: DataFrame | Draws, value: Column, cluster: str = "cluster",
                    by: list[str] = (), member: Column | None = None) -> DataFrame:
    """Mean of a value in each replicate, optionally over member rows only.

    Rows are summed per cluster first, so the join has one row per cluster and replicate whatever the
    cluster's size.
    """
    by = list(by)
    inside = F.lit(True) if member is None else member
    sums = rows.groupBy(*by, cluster).agg(
        F.sum(F.when(inside, value)).alias("_s"), F.count(F.when(inside, value)).alias("_n"))
    if isinstance(mult, Draws):
        return means(sums, mult, by, cluster)
    return _null_safe(sums, mult, [cluster], "inner").groupBy(*by, "b").agg(
        (F.sum(F.col("m") * F.col("_s")) / F.sum(F.col("m") * F.col("_n"))).alias("value"))


def mean_interval(rows: DataFrame, mult: DataFrame | Draws, value: Column, cluster: str = "cluster",
                  by: list[str] = (), member: Column | None = None) -> DataFrame:
    reps = replicate_means(rows, mult, value, cluster, by, member).filter("b > 0")
    return reps.groupBy(*by).agg(*interval("value"))


def replicate_spearman(rows: DataFrame, mult: DataFrame | Draws, by: list[str], a: str, b: str, ident: str = "id",
                       cluster: str = "cluster") -> DataFrame:
    """Spearman of each replicate: copies of a row share their middle rank. With ``Draws``, rows have ``ord`` too."""
    if isinstance(mult, Draws):
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest <= RANKED:
            return correlations(rows, mult, by, a, b, ident)
        cluster = "ord"
        numbers = mult.clusters.select("ord")
        mult = multiplicities(numbers, mult.replicates, "ord", mult.seed, mult.with_point)
    return spearman_by_replicate(rows, mult, by, a, b, ident, cluster)
