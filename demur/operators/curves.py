"""Risk-coverage curves.

A long score table has one row per (gate, id). A curve keeps the lowest scores at each coverage and reports
the mean loss of the kept rows. With strata the same share is kept inside each stratum. With a weight
column (bootstrap multiplicities) each row counts that many times, without copying rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import coverage_targets, find_splits, take_at

# The coverage grids.
COVERAGES = [round(1.0 - 0.05 * i, 2) for i in range(19)]
DENSE = [round(0.10 + 0.02 * i, 2) for i in range(46)]
SENSITIVITY = [0.95, 0.9, 0.8, 0.7, 0.5]


def kept_totals(rows: DataFrame, by: list[str], score: str = "score", loss: str = "err", ident: str = "id",
                coverages=COVERAGES, strata: list[str] = (), weight: str | None = None,
                rows_per_bucket: int | None = None, split_source: DataFrame | None = None,
                split_keys: list[str] | None = None) -> DataFrame:
    """Kept count ``k`` and summed loss ``kept`` per group, stratum and coverage.

    Split points for large groups are sampled from ``split_source`` by ``split_keys``; replicated rows pass
    the rows they come from.
    """
    keys = list(by) + list(strata)
    splits = find_splits(rows if split_source is None else split_source,
                         list(by) if split_keys is None else list(split_keys), [score, ident], rows_per_bucket)
    return take_at(rows, keys, [score, ident], coverage_targets(coverages), {"kept": loss}, weight=weight,
                   splits=splits)


def curve(rows: DataFrame, by: list[str] = ("gate",), strata: list[str] = (), **options) -> DataFrame:
    """Columns ``by``, ``coverage``, ``k``, ``risk``."""
    by = list(by)
    kept = kept_totals(rows, by, strata=strata, **options)
    if strata:
        kept = kept.groupBy(*by, "coverage").agg(F.sum("k").alias("k"), F.sum("kept").alias("kept"))
    return kept.select(*by, "coverage", "k", (F.col("kept") / F.col("k")).alias("risk"))


def with_perfect(rows: DataFrame, like: str | None = None, gate: str = "gate", score: str = "score",
                 loss: str = "err") -> DataFrame:
    """Add the perfect refuser: the rows of one gate again, scored by the loss itself."""
    first = like or rows.select(F.min(gate)).first()[0]
    perfect = rows.filter(F.col(gate) == first).withColumn(gate, F.lit("perfect")).withColumn(
        score, F.col(loss).cast("double"))
    return rows.unionByName(perfect)


def random_curve(rows: DataFrame, by: list[str] = (), loss: str = "err", coverages=COVERAGES,
                 weight: str | None = None, gate: str = "gate") -> DataFrame:
    """The random refuser's expectation: the mean loss at every coverage. ``rows`` hold one gate only."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    flat = rows.groupBy(*by).agg(F.sum(w).alias("n"), (F.sum(w * F.col(loss)) / F.sum(w)).alias("risk"))
    return coverage_targets(coverages).explode(flat).select(
        *by, F.lit("random").alias(gate), "coverage", "k", "risk")


def aurc(curves: DataFrame, by: list[str] = ("gate",)) -> DataFrame:
    """Area under each curve by the trapezoid rule, divided by the coverage span."""
    w = Window.partitionBy(*by).orderBy("coverage")
    step = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2
    return curves.select("*", step.alias("_a")).groupBy(*by).agg(
        (F.sum("_a") / (F.max("coverage") - F.min("coverage"))).alias("aurc"))


def pivot_reference(table: DataFrame, value: str, by: list[str], gate: str = "gate") -> DataFrame:
    """Attach the value of the random and the perfect gate to every row of the same ``by`` group."""
    part = Window.partitionBy(*by)
    pick = lambda name: F.max(F.when(F.col(gate) == name, F.col(value))).over(part)
    return table.select("*", pick("random").alias(f"{value}_random"), pick("perfect").alias(f"{value}_perfect"))


def gap_share(value: str) -> Column:
    """Share of the random-to-perfect gap that a gate closes."""
    return ((F.col(f"{value}_random") - F.col(value))
            / (F.col(f"{value}_random") - F.col(f"{value}_perfect")))
