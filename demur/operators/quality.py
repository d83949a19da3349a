"""Image-quality metrics: one pass over image rows, all registered metrics as columns.

A metric is a function of the gray image and the red-green-blue image of one row. Register more with
``METRICS[name] = function``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Gray weights (16-bit, rounded), the column grid of block artefacts, the high-band radius.
GRAY = (19595, 38470, 7471)
BLOCK = 8
HIGH_BAND = 0.25


def to_gray(rgb: np.ndarray) -> np.ndarray:
    weighted = rgb.astype(np.int64) @ np.array(GRAY) + (1 << 15)
    return (weighted >> 16).astype(np.float64)


def _laplacian(gray, rgb):
    up_down = np.diff(gray, n=2, axis=0)[:, 1:-1]
    left_right = np.diff(gray, n=2, axis=1)[1:-1, :]
    return (up_down + left_right).var()


def _gradient(gray, rgb):
    wide = (gray[:, 2:] - gray[:, :-2])[1:-1]
    tall = (gray[2:] - gray[:-2])[:, 1:-1]
    return (wide ** 2 + tall ** 2).mean()


def _blocks(gray, rgb):
    steps = np.abs(np.diff(gray, axis=1))
    grid = np.arange(steps.shape[1]) % BLOCK == BLOCK - 1
    inner = steps[:, ~grid]
    base = inner.mean() if inner.size else 0.0
    if base == 0:
        return 0.0
    return steps[:, grid].mean() / base - 1 if grid.any() else np.nan


def _red_blue(gray, rgb):
    blue = rgb[..., 2].mean()
    return rgb[..., 0].mean() / blue if blue > 0 else np.nan


def _saturation(gray, rgb):
    top = rgb.max(2).astype(np.float64)
    return ((top - rgb.min(2)) / np.maximum(top, 1)).mean()


def _high_share(gray, rgb):
    power = np.abs(np.fft.fft2(gray - gray.mean())) ** 2
    place = lambda n: np.fft.fftfreq(n, 1 / n) / max(n // 2, 1)
    radius = np.hypot(place(gray.shape[0])[:, None], place(gray.shape[1])[None, :])
    total = power.sum()
    return power[radius > HIGH_BAND].sum() / total if total > 0 else np.nan


METRICS: dict[str, Callable] = {
    "lap_var": _laplacian, "tenengrad": _gradient, "blockiness": _blocks,
    "brightness": lambda gray, rgb: gray.mean(), "rms_contrast": lambda gray, rgb: gray.std(),
    "colour_rb": _red_blue, "saturation": _saturation, "hf_ratio": _high_share,
}


def measure(images: DataFrame, metrics: dict[str, Callable] = METRICS) -> DataFrame:
    """Add the metric columns to rows (height, width, data) with 8-bit blue-green-red pixels."""
    names, functions = list(metrics), list(metrics.values())

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def values(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for h, w, d in zip(height, width, data):
            pixels = np.frombuffer(d, np.uint8).reshape(h, w, -1)
            # A single channel stands for all three.
            rgb = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[..., 2::-1]
            gray = to_gray(rgb)
            rows.append([float(f(gray, rgb)) for f in functions])
        return pd.DataFrame(rows, columns=names)

    # The Arrow transfer turns NaN into null; an undefined metric stays NaN.
    measured = images.select("*", values("height", "width", "data").alias("_m"))
    return measured.select("*", *[F.coalesce(f"_m.{n}", F.lit(float("nan"))).alias(n) for n in names]).drop("_m")


def response(measured: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Mean of every metric per condition."""
    return measured.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics or METRICS])
