"""Where the variance of an error lives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def variance_split(rows: DataFrame, entity: str, condition: str, value: str) -> DataFrame:
    """Two-way additive split: population variance of entity effect, condition effect and the rest, in % of
    their sum.

    Rows are folded into (entity, condition) cells first. Conditions are few, entities are joined on their
    key.
    """
    n = F.count(F.lit(1))
    cells = rows.groupBy(entity, condition).agg(
        n.alias("n"), F.sum(value).alias("s"), (F.var_pop(value) * n).alias("ss"))
    grand = cells.agg((F.sum("s") / F.sum("n")).alias("g")).first()["g"]
    mean = F.sum("s") / F.sum("n") - F.lit(grand)
    by_entity = cells.groupBy(entity).agg(mean.alias("_e"))
    by_condition = cells.groupBy(condition).agg(mean.alias("_c"))
    joined = cells.join(by_entity, entity).join(F.broadcast(by_condition), condition)
    total = F.sum("n")
    off = F.col("s") / F.col("n") - F.lit(grand) - F.col("_e") - F.col("_c")
    var = lambda c: F.sum(F.col("n") * c * c) / total - F.pow(F.sum(F.col("n") * c) / total, 2)
    rest = (F.sum("ss") + F.sum(F.col("n") * off * off)) / total - F.pow(F.sum(F.col("n") * off) / total, 2)
    parts = joined.agg(var(F.col("_e")).alias("entity"), var(F.col("_c")).alias("condition"), rest.alias("rest"))
    whole = F.col("entity") + F.col("condition") + F.col("rest")
    return parts.select(*[(100 * F.col(c) / whole).alias(c) for c in ("entity", "condition", "rest")])


def intraclass(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way intraclass correlation from the count, mean and spread of every cluster."""
    n = F.count(F.lit(1))
    groups = rows.groupBy(cluster).agg(n.alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * n).alias("ss"))
    stats = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("N")) / (F.col("k") - 1)
    within = F.col("within") / (F.col("N") - F.col("k"))
    size = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    return stats.select(F.col("k").alias("clusters"), F.col("N").alias("n"),
                        ((between - within) / (between + (size - 1) * within)).alias("icc"))
