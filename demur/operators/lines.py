"""One-feature ridge from grouped moments.

The moments (n, means, central sums of squares and products) are ordinary aggregates with partial
combine. They can be added and subtracted, so the statistics of "all but one fold" need no second scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MOMENTS = ["n", "mx", "my", "sxx", "sxy"]


@dataclass(frozen=True)
class Line:
    """Fitted line; a few numbers, used as literals in expressions."""
    mx: float
    my: float
    w: float

    def predict(self, x: Column) -> Column:
        return (x - F.lit(self.mx)) * F.lit(self.w) + F.lit(self.my)


def moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
                                 (F.var_pop(x) * n).alias("sxx"), (F.covar_pop(x, y) * n).alias("sxy"))


def merge_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of groups, from the moments of each group."""
    total = F.sum("n")
    mx = F.sum(F.col("n") * F.col("mx")) / total
    my = F.sum(F.col("n") * F.col("my")) / total
    sxx = F.sum(F.col("sxx") + F.col("n") * F.col("mx") * F.col("mx")) - total * mx * mx
    sxy = F.sum(F.col("sxy") + F.col("n") * F.col("mx") * F.col("my")) - total * mx * my
    return df.groupBy(*keys).agg(total.alias("n"), mx.alias("mx"), my.alias("my"), sxx.alias("sxx"), sxy.alias("sxy"))


def without(total: str, part: str) -> list[Column]:
    """Moments of ``total`` minus ``part``, both struct columns of MOMENTS."""
    t, p = (lambda f: F.col(f"{total}.{f}")), (lambda f: F.col(f"{part}.{f}"))
    n = t("n") - p("n")
    mx = (t("n") * t("mx") - p("n") * p("mx")) / n
    my = (t("n") * t("my") - p("n") * p("my")) / n
    scale = n * p("n") / t("n")
    sxx = t("sxx") - p("sxx") - (mx - p("mx")) * (mx - p("mx")) * scale
    sxy = t("sxy") - p("sxy") - (mx - p("mx")) * (my - p("my")) * scale
    return [n.alias("n"), mx.alias("mx"), my.alias("my"), sxx.alias("sxx"), sxy.alias("sxy")]


def slope(alpha: float) -> Column:
    """Ridge slope with an unpenalised intercept, over the moment columns."""
    return F.col("sxy") / (F.col("sxx") + F.lit(float(alpha)))


def fit_line(df: DataFrame, x: str, y: str, alpha: float) -> Line:
    row = moments(df, [], x, y).select("mx", "my", slope(alpha).alias("w")).first()
    return Line(row["mx"], row["my"], row["w"])


def predict(x: Column) -> Column:
    """Prediction from joined parameter columns ``mx, my, w``."""
    return (x - F.col("mx")) * F.col("w") + F.col("my")


def pair_heads(df: DataFrame, keys: list[str], a: str, b: str, y: str, alpha: float) -> DataFrame:
    """Two-feature ridge per key in closed form: columns keys, ``ma, mb, my, wa, wb``."""
    n = F.count(F.lit(1))
    m = df.groupBy(*keys).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), (F.var_pop(a) * n + alpha).alias("aa"),
        (F.var_pop(b) * n + alpha).alias("bb"), (F.covar_pop(a, b) * n).alias("ab"), (F.covar_pop(a, y) * n).alias("ay"),
        (F.covar_pop(b, y) * n).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return m.select(*keys, "ma", "mb", "my", ((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).alias("wa"),
                    ((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).alias("wb"))
