"""Scalar expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even_k(coverage: Column, n: Column) -> Column:
    """Rows kept at a coverage: half-even rounding of ``coverage * n``, one row at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.rint(coverage * n).cast("bigint"))


def relative_error(err: Column, truth: Column, floor: float = 50.0) -> Column:
    return err / F.greatest(truth, F.lit(floor))


def percent_true(flag: Column) -> Column:
    """Share of rows where the flag holds, as an aggregate."""
    return F.avg(flag.cast("double"))


def significant(x: Column, digits: int = 6) -> Column:
    """Value rounded to a number of significant digits (the precision of the text sink)."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def interval_score(truth: Column, lo: Column, hi: Column, alpha: float) -> Column:
    """Width of a range plus ``2 / alpha`` times the distance by which it misses."""
    miss = F.greatest(lo - truth, F.lit(0.0)) + F.greatest(truth - hi, F.lit(0.0))
    return hi - lo + F.lit(2.0 / alpha) * miss


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
