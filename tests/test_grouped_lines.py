"""Quantile lines of many groups in the same passes, against each group solved alone."""

import numpy as np
import pandas as pd
import pytest

from demur.operators import quantreg


@pytest.mark.parametrize("limits", [(20_000, 500_000), (150, 200), (60, 40)])
def test_groups_equal_each_alone(spark, limits):
    draw = np.random.default_rng(4)
    parts = []
    for g, n in enumerate((1500, 400, 7, 90)):
        x = draw.uniform(0, 10, n).round(1 if g == 1 else 6)
        y = (3 + g * x + draw.normal(0, 1 + x / 5, n)).round(1 if g == 1 else 6)
        parts.append(pd.DataFrame({"g": g, "x": x, "y": y}))
    rows = pd.concat(parts)
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([(0, None, 1.0), (1, 2.0, None)], "g long, x double, y double"))
    got = quantreg.fit_groups(df, ["g"], "x", "y", [0.1, 0.8], *limits).collect()
    assert len(got) == 8

    def loss(x, y, tau, a, b):
        r = y - a - b * x
        return np.maximum(tau * r, (tau - 1) * r).sum()

    for r in got:
        p = parts[r["g"]]
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        alone = loss(x, y, r["tau"], *quantreg.solve(x, y, r["tau"]))
        assert loss(x, y, r["tau"], r["a"], r["b"]) == pytest.approx(alone, rel=1e-9, abs=1e-9)


def test_no_rows_no_lines(spark):
    assert quantreg.fit_groups(spark.createDataFrame([], "g long, x double, y double"), ["g"], "x", "y", [0.5]).collect() == []
