"""Leak-free splits: whole clusters go to one side. All draws are stateless hash uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demur.functions.draws import uniform

from .ranking import running

# Default seed and calibration share.
SEED = 760
CALIB_SHARE = 0.30


def cluster_sizes(rows: DataFrame, cluster: str = "cluster", by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("size"))


def carve(sizes: DataFrame, cluster: str = "cluster", seed=SEED, share: float = CALIB_SHARE,
          by: list[str] = ()) -> DataFrame:
    """Mark the clusters of the calibration side: in drawn order, whole clusters until the share is reached.

    ``sizes`` has one row per cluster (and per ``by`` group, each carved on its own). ``seed`` may be a column.
    """
    by = list(by)
    drawn = sizes.withColumn("_u", uniform("carve", seed, F.col(cluster)))
    run = running(drawn, ["_u", cluster], by, rank="_upto", weight="size", size="_total")
    return run.withColumn("calib", (F.col("_upto") - F.col("size")) < F.col("_total") * share).drop(
        "_u", "_upto", "_total")


def carve_rows(rows: DataFrame, ident: str = "id", seed=SEED, share: float = CALIB_SHARE) -> DataFrame:
    """Row-level carve: exactly ``round(share * n)`` rows, drawn without regard to clusters."""
    drawn = rows.withColumn("_u", uniform("row-carve", seed, F.col(ident)))
    run = running(drawn, ["_u", ident], rank="_r", size="_n")
    return run.withColumn("calib", F.col("_r") <= F.rint(F.col("_n") * share)).drop("_u", "_r", "_n")


def deal_by_size(sizes: DataFrame, folds: int, cluster: str = "cluster", seed=SEED,
                 by: list[str] = ()) -> DataFrame:
    """Folds of about equal row count: clusters in order of size are dealt back and forth over the folds.

    A sequential largest-first assignment needs one task for all clusters; the back-and-forth deal is a rank
    and scales, with loads that differ by one largest cluster at most.
    """
    drawn = sizes.withColumn("_u", uniform("fold", seed, F.col(cluster))).withColumn("_desc", -F.col("size"))
    run = running(drawn, ["_desc", "_u", cluster], list(by), rank="_r")
    place = (F.col("_r") - 1) % (2 * folds)
    fold = F.when(place < folds, place).otherwise(2 * folds - 1 - place)
    return run.withColumn("fold", fold.cast("int")).drop("_u", "_desc", "_r")


def deal_round_robin(sizes: DataFrame, folds: int, cluster: str = "cluster", seed=SEED,
                     by: list[str] = ()) -> DataFrame:
    """Folds dealt one after the other over the clusters in drawn order."""
    drawn = sizes.withColumn("_u", uniform("robin", seed, F.col(cluster)))
    run = running(drawn, ["_u", cluster], list(by), rank="_r")
    return run.withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_u", "_r")


def mixture_pick(ident: Column, mixture: dict[str, float], seed=SEED + 1) -> Column:
    """One condition per id, drawn with the given weights (inverse of the cumulative shares)."""
    total, upto = sum(mixture.values()), 0.0
    draw, names = uniform("mixture", seed, ident), list(mixture)
    picked = None
    for name in names[:-1]:
        upto += mixture[name] / total
        picked = F.when(draw < upto, name) if picked is None else picked.when(draw < upto, name)
    return F.lit(names[-1]) if picked is None else picked.otherwise(names[-1])


def permute(rows: DataFrame, value: str, ident: str = "id", seed=SEED, within: list[str] = (),
            name: str = "shuffled") -> DataFrame:
    """The column in a drawn order: row r of the id order gets the value of row r of the drawn order.

    ``within`` shuffles inside groups only. Both ranks are distributed, so one huge group is no problem.
    """
    within = list(within)
    drawn = rows.withColumn("_u", uniform("permute", seed, F.col(ident)))
    to = running(drawn, [ident], within, rank="_r").drop("_u")
    source = running(drawn.select(*within, ident, "_u", F.col(value).alias(name)), ["_u", ident], within, rank="_r")
    return to.join(source.select(*within, "_r", name), within + ["_r"]).drop("_r")
