"""Sufficient statistics of wide features, and everything that is solved from them.

Each task folds its batches into one Gram matrix per key or weight column and sends the upper half of it; the partial rows are added up
after a shuffle on the row index. Tasks read as many input splits as it takes to have no more of them than cores, so what is shuffled is bounded by cores x keys,
whatever the size of the input. ``on_each`` solves every key on the executors, one key's matrix in one task, and returns what was solved; only
the d x d matrix of an unkeyed fit comes to the driver. Statistics add and subtract, so a fit without one fold costs no second scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from demur.sources.staging import stage

# The penalty grid (quarter decades), standardising epsilon, variance floor, components.
ALPHA_GRID = [10 ** (i / 4) for i in range(25)]
EPSILON = 1e-8
VARIANCE_FLOOR = 1e-12
COMPONENTS = 64


@dataclass(frozen=True)
class Stats:
    """Count, means and central products of features (d) and targets (t)."""
    n: float
    mx: np.ndarray
    my: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray

    def _raw(self) -> tuple:
        return (self.n, self.n * self.mx, self.n * self.my, self.sxx + self.n * np.outer(self.mx, self.mx),
                self.sxy + self.n * np.outer(self.mx, self.my))

    @staticmethod
    def _central(n, sx, sy, sxx, sxy) -> "Stats":
        mx, my = sx / n, sy / n
        return Stats(n, mx, my, sxx - n * np.outer(mx, mx), sxy - n * np.outer(mx, my))

    def __add__(self, other: "Stats") -> "Stats":
        return Stats._central(*[a + b for a, b in zip(self._raw(), other._raw())])

    def __sub__(self, other: "Stats") -> "Stats":
        return Stats._central(*[a - b for a, b in zip(self._raw(), other._raw())])

    @property
    def sd(self) -> np.ndarray:
        """Population standard deviation of every feature."""
        return np.sqrt(np.maximum(np.diag(self.sxx), 0) / self.n)

    def scaled(self, scale: np.ndarray) -> "Stats":
        """Statistics of centred features divided by ``scale``."""
        return Stats(self.n, np.zeros_like(self.mx), self.my, self.sxx / np.outer(scale, scale), self.sxy / scale[:, None])

    def ridge(self, alpha: float) -> np.ndarray:
        """Weights (d x t) of a ridge with an unpenalised intercept; all targets in one solve."""
        return np.linalg.solve(self.sxx + alpha * np.eye(len(self.mx)), self.sxy)

    def components(self, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
        """Leading principal directions (d x k) and their sample variances."""
        values, vectors = np.linalg.eigh(self.sxx / (self.n - 1))
        top = np.argsort(values)[::-1][:min(k, len(values))]
        return vectors[:, top], np.maximum(values[top], VARIANCE_FLOOR)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(np.float64)


def _matrix_rows(df: DataFrame, x: str, ys: list[str] | str, key: str | None, weights: str | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (key, i, v) of the added up matrices, from the diagonal on; and the points that were subtracted from features and targets."""
    shift_x, shift_y = _shift(df, x, ys)
    d, t = len(shift_x), len(shift_y)
    p = 1 + d + t
    names = [ys] if isinstance(ys, str) else list(ys)
    cols = [F.col(x).alias("x"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(names)]]
    if key:
        cols.append(F.col(key).cast("string").alias("key"))
    if weights:
        cols.append(F.col(weights).alias("w"))
    many = isinstance(ys, str)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            y = _matrix(b["y0"]) if many else np.column_stack([b[f"y{i}"].to_numpy(np.float64) for i in range(t)])
            a = np.column_stack([np.ones(len(b)), _matrix(b["x"]) - shift_x, y - shift_y])
            if weights:
                w = _matrix(b["w"])
                for i in range(w.shape[1]):
                    acc[str(i)] = acc.get(str(i), 0) + a.T @ (a * w[:, i:i + 1])
            elif key:
                keys = b["key"].to_numpy()
                for k in pd.unique(keys):
                    part = a[pd.isna(keys) if k is None else keys == k]
                    acc[k] = acc.get(k, 0) + part.T @ part
            else:
                acc[""] = acc.get("", 0) + a.T @ a
        for k, m in acc.items():
            yield pd.DataFrame({"key": k, "i": np.arange(p, dtype=np.int32), "v": [m[i, i:] for i in range(p)]})

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, i, v in zip(b["key"], b["i"], b["v"]):
                acc[k, i] = acc[k, i] + v if (k, i) in acc else np.array(v)
        if acc:
            yield pd.DataFrame([(k, i, v) for (k, i), v in acc.items()], columns=["key", "i", "v"])

    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*cols).coalesce(cores).mapInPandas(partial, _ROWS).repartition("key", "i").mapInPandas(combine, _ROWS)
    return rows, shift_x, shift_y


_ROWS = "key string, i int, v array<double>"


def _stats(rows: Iterator[tuple[int, np.ndarray]], shift_x: np.ndarray, shift_y: np.ndarray) -> Stats:
    d, p = len(shift_x), 1 + len(shift_x) + len(shift_y)
    m = np.zeros((p, p))
    for i, v in rows:
        m[i, i:] += v
    m = np.triu(m) + np.triu(m, 1).T
    n = m[0, 0]
    mx, my = m[0, 1:1 + d] / n, m[0, 1 + d:] / n
    return Stats(n, mx + shift_x, my + shift_y, m[1:1 + d, 1:1 + d] - n * np.outer(mx, mx), m[1:1 + d, 1 + d:] - n * np.outer(mx, my))


def on_each(df: DataFrame, x: str, ys: list[str] | str, solve: Callable[[Stats], dict], schema: str, key: str | None = None, weights: str | None = None,
            leave_out: bool = False) -> DataFrame:
    """``key`` (text) and what ``solve`` makes of the statistics of each key value or weight index, by the names and types of ``schema``.

    Every key is solved in a task of its own. ``leave_out`` gives each key the statistics of all rows of the other keys; its matrix is then added to
    those of the others, so it is meant for folds.
    """
    rows, shift_x, shift_y = _matrix_rows(df, x, ys, key, weights)
    if leave_out:
        rows = stage(rows, "gram")
        others = F.filter(F.lit([r["key"] for r in rows.select("key").distinct().collect()]), lambda k: ~k.eqNullSafe(F.col("key")))
        rows = rows.select(F.explode(others).alias("key"), "i", "v")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        made = solve(_stats(zip(t["i"], t["v"]), shift_x, shift_y))
        return pd.DataFrame({"key": [t["key"].iloc[0]]} | {n: [np.asarray(made[n]).tolist()] for n in names})

    return rows.groupBy("key").applyInPandas(run, f"key string, {schema}")


def gram(df: DataFrame, x: str, ys: list[str] | str, key: str | None = None, weights: str | None = None) -> dict:
    """Statistics as ``{None: Stats}`` on the driver, which is one matrix; or per key value or weight index, for a handful of these.

    ``x`` is an array column, ``ys`` target columns or one array column of targets. ``weights`` is an array column: entry w weighs the row in the w-th result,
    which serves bootstrap multiplicities and overlapping fits in a single scan. Many keys are solved by ``on_each``.
    """
    rows, shift_x, shift_y = _matrix_rows(df, x, ys, key, weights)
    found: dict[str, list] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["key"], []).append((r["i"], np.array(r["v"])))
    return {int(k) if weights else k if key else None: _stats(m, shift_x, shift_y) for k, m in found.items()}


def _shift(df: DataFrame, x: str, ys) -> tuple[np.ndarray, np.ndarray]:
    """Any point near the data; subtracting it keeps the sums well conditioned and changes no result."""
    names = [ys] if isinstance(ys, str) else list(ys)
    found = df.select(F.col(x).cast("array<double>").alias("x"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(names)])
    # A row without odd values, if there is one.
    row = found.where(F.forall("x", lambda v: F.abs(v) < float("inf"))).first() or found.first()
    y = np.array(row["y0"], float) if isinstance(ys, str) else np.array([row[f"y{i}"] for i in range(len(names))], float)
    return np.nan_to_num(np.array(row["x"], float), posinf=0, neginf=0), np.nan_to_num(y, posinf=0, neginf=0)


def linear_scores(x: Column, centre: np.ndarray, weights: np.ndarray, intercept: np.ndarray) -> Column:
    """Predictions of many linear heads at once: an array column, one matrix product per Arrow batch."""
    centre, weights, intercept = np.asarray(centre), np.atleast_2d(weights), np.asarray(intercept)

    @F.pandas_udf(ArrayType(DoubleType()))
    def predict(v: pd.Series) -> pd.Series:
        return pd.Series(list((_matrix(v) - centre) @ weights + intercept)) if len(v) else pd.Series([], dtype=object)

    return predict(x)


def standardise(x: Column, mean: np.ndarray, scale: np.ndarray) -> Column:
    m, s = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v)) for v in scale])
    return F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b)


def pick_alpha(fit: Stats, calib: DataFrame, x: str, y: str, target: int = 0, grid: list[float] = ALPHA_GRID) -> tuple:
    """Penalty with the lowest mean absolute error on calibration; the first of equals wins.

    One Gram serves all penalties, and one pass over calibration scores all heads. Returns the penalty and
    the errors per penalty.
    """
    one = Stats(fit.n, fit.mx, fit.my[target:target + 1], fit.sxx, fit.sxy[:, target:target + 1])
    heads = np.column_stack([one.ridge(a)[:, 0] for a in grid])
    preds = linear_scores(F.col(x), fit.mx, heads, np.full(len(grid), one.my[0]))
    errs = calib.select(F.posexplode(preds).alias("i", "p"), F.col(y).alias("y")).groupBy("i").agg(
        F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).collect()
    mae = [r["mae"] for r in sorted(errs, key=lambda r: r["i"])]
    best = min(range(len(grid)), key=lambda i: (mae[i], i))
    return grid[best], mae
