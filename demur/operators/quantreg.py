"""Linear quantile regression on one feature, exact, over any number of rows.

A sample gives a first line. Rows far from it can only stay on their side, so they enter as three sums; only
rows near the line are solved exactly. While too many rows are near, a sample of them gives a better line and a narrower
band, one aggregate per pass. The fit is checked: if a summed row turns out to lie on the other side, the band
is widened and the step repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from demur.sources.staging import stage

SAMPLE_ROWS = 20_000
#: Distinct rows near the line that the driver solves at once.
NEAR_ROWS = 500_000


def _pivot(x, y, w, tau, i, extra):
    """Best line through point i: an exact weighted quantile over slopes; the index of a second point, or i itself."""
    dx, dy = x - x[i], y - y[i]
    side = dx != 0
    if not side.any():
        return i
    s, pull, pos = dy[side] / dx[side], np.abs(dx[side]) * w[side], dx[side] > 0
    order = np.argsort(s, kind="stable")
    # Derivative of the loss in the slope, starting at minus infinity; far rows add a constant.
    start = -np.where(pos, tau, 1 - tau) @ pull + extra[1] - extra[0] * x[i]
    at = min(int(np.searchsorted(start + np.cumsum(pull[order]), -1e-9 * pull.sum())), len(order) - 1)
    return int(np.flatnonzero(side)[order[at]])


def _loss(x, y, w, tau, a, b, extra):
    r = y - a - b * x
    return np.sum(w * np.maximum(tau * r, (tau - 1) * r)) + extra[0] * a + extra[1] * b


def _through(x, y, i, j):
    if x[j] == x[i]:
        return y[i], 0.0
    b = (y[j] - y[i]) / (x[j] - x[i])
    return y[i] - b * x[i], b


def solve(x: np.ndarray, y: np.ndarray, tau: float, extra=(0.0, 0.0), w: np.ndarray | None = None) -> tuple[float, float]:
    """Intercept and slope; ``extra`` is the linear term the far rows add to the loss, ``w`` counts repeated rows.

    Moves from line to line through data points while the loss falls. The loss is convex, and around a line
    its slope can only turn at rotations about the points on it; so a line is the best one when no rotation about any of
    its points, one for each x, lowers the loss. That is the test for stopping.
    """
    w = np.ones(len(x)) if w is None else w
    order = np.argsort(y, kind="stable")
    i = int(order[min(int(np.searchsorted(np.cumsum(w[order]), tau * w.sum())), len(y) - 1)])
    a, b = _through(x, y, i, _pivot(x, y, w, tau, i, extra))
    best = _loss(x, y, w, tau, a, b, extra)
    while True:
        on = np.flatnonzero(np.abs(y - a - b * x) <= 1e-10 * (1 + np.abs(y) + abs(a)))
        pivots = on[np.unique(x[on], return_index=True)[1]]
        for i in pivots.tolist():
            line_ = _through(x, y, i, _pivot(x, y, w, tau, i, extra))
            loss = _loss(x, y, w, tau, *line_, extra)
            if loss < best - 1e-12 * max(1.0, abs(best)):
                best, (a, b) = loss, line_
                break
        else:
            return float(a), float(b)


def fit(df: DataFrame, x: str, y: str, tau: float, sample_rows: int = SAMPLE_ROWS, near_rows: int = NEAR_ROWS) -> tuple[float, float]:
    """Intercept and slope of the ``tau`` quantile of ``y`` given ``x``; rows with a null count as absent."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")

    def drawn(part: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        p = part.sample(fraction=min(1.0, 1.5 * sample_rows / size), seed=seed).toPandas() if size > sample_rows else part.toPandas()
        return p["x"].to_numpy(), p["y"].to_numpy()

    sx, sy = drawn(rows, n, 11)
    a, b = solve(sx, sy, tau)
    # The band, as residuals from the line (a, b); everything is near at first if the sample is everything.
    spread = 3.0 / np.sqrt(len(sy)) if len(sy) < n else 1.0
    lo, hi = _band(sy - a - b * sx, spread)
    wider, seed = 1.0, 12
    while True:
        r = F.col("y") - F.lit(a) - F.lit(b) * F.col("x")
        below, above = r < F.lit(lo), r > F.lit(hi)
        one = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
        s = rows.agg(one(below, F.lit(1.0)).alias("nb"), one(below, F.col("x")).alias("xb"), one(above, F.lit(1.0)).alias("na"),
                     one(above, F.col("x")).alias("xa")).first()
        extra = ((1 - tau) * s["nb"] - tau * s["na"], (1 - tau) * s["xb"] - tau * s["xa"])
        near = rows.filter(~below & ~above)
        size = int(n - s["nb"] - s["na"])
        distinct = near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
        if size > near_rows and wider < 1e6 and distinct.limit(near_rows + 1).count() > near_rows:
            sx, sy = drawn(near, size, seed)
            seed += 1
            share = len(sy) / size
            a2, b2 = solve(sx, sy, tau, (extra[0] * share, extra[1] * share))
            res = sy - a2 - b2 * sx
            lo2, hi2 = _band(res, min(1.0, wider * 3.0 / np.sqrt(len(sy))))
            # Only a band that leaves most of these rows out is a step ahead.
            if np.mean((res >= lo2) & (res <= hi2)) < 0.5:
                a, b, lo, hi = a2, b2, lo2, hi2
                continue
        p = distinct.toPandas()
        if not len(p):
            lo, hi = _wide(lo, hi)
            continue
        a2, b2 = solve(p["x"].to_numpy(), p["y"].to_numpy(), tau, extra, p["w"].to_numpy(float))
        r2 = F.col("y") - F.lit(a2) - F.lit(b2) * F.col("x")
        slack = 1e-9 * (1 + abs(a2))
        if not rows.filter((below & (r2 > slack)) | (above & (r2 < -slack))).limit(1).count():
            return a2, b2
        wider *= 4
        lo, hi = _wide(lo, hi)


def fit_groups(df: DataFrame, keys: list[str], x: str, y: str, taus: list[float], sample_rows: int = SAMPLE_ROWS,
               near_rows: int = NEAR_ROWS) -> DataFrame:
    """The ``taus`` quantile lines of every group at once, exact: columns keys, ``tau, a, b``; rows with a null ``x`` or ``y`` count as absent.

    All groups go through the same passes. A pass sums the rows far from each line in one aggregate, solves the distinct near rows of a
    group in a task of its own, and checks every new line against all rows; groups that hold take no part in the next pass. The driver only
    learns whether groups are left.
    """
    keys = list(keys)
    each, X, Y = [*keys, "tau"], F.col("_x"), F.col("_y")
    rows = stage(df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"]), "lines")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "tau double"])
    names = [*each, "a", "b", "lo", "hi", "wider", "whole", "done"]
    state_schema = f"{head}, a double, b double, lo double, hi double, wider double, whole boolean, done boolean"

    def start(p):
        first = [p[k].iloc[0] for k in keys]
        px, py, n, out = p["_x"].to_numpy(), p["_y"].to_numpy(), p["_n"].iloc[0], []
        for tau in taus:
            a, b = solve(px, py, tau)
            lo, hi = _band(py - a - b * px, 3.0 / np.sqrt(len(py)) if len(py) < n else 1.0)
            out.append([*first, tau, a, b, lo, hi, 1.0, False, len(py) == n])
        return pd.DataFrame(out, columns=names)

    def step(p):
        first = [p[k].iloc[0] for k in each]
        s = p.iloc[0]
        px, py, w, tau = p["_x"].to_numpy(), p["_y"].to_numpy(), p["_w"].to_numpy(float), s["tau"]
        extra = ((1 - tau) * s["nb"] - tau * s["na"], (1 - tau) * s["xb"] - tau * s["xa"])
        if not s["_part"]:
            return pd.DataFrame([[*first, *solve(px, py, tau, extra, w), None, None, True]], columns=[*each, "a2", "b2", "lo2", "hi2", "full"])
        share = w.sum() / s["_near"]
        a, b = solve(px, py, tau, (extra[0] * share, extra[1] * share), w)
        res = py - a - b * px
        lo, hi = _band(res, min(1.0, s["wider"] * 3.0 / np.sqrt(len(res))))
        # Only a band that leaves most of these rows out is a step ahead; otherwise the next pass solves all of them.
        ahead = np.mean((res >= lo) & (res <= hi)) < 0.5
        return pd.DataFrame([[*first, a if ahead else None, b, lo, hi, False]], columns=[*each, "a2", "b2", "lo2", "hi2", "full"])

    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sampled = rows.join(sizes, keys).where((F.col("_n") <= sample_rows) | (F.rand(11) < 1.5 * sample_rows / F.col("_n")))
    state = stage(sampled.groupBy(*keys).applyInPandas(start, state_schema), "line-state")
    seed = 12
    while not state.where(~F.col("done")).isEmpty():
        pending = state.where(~F.col("done"))
        r = Y - F.col("a") - F.col("b") * X
        below, above = r < F.col("lo"), r > F.col("hi")
        total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
        joined = rows.join(pending, keys)
        far = joined.groupBy(*each).agg(total(below, F.lit(1.0)).alias("nb"), total(below, X).alias("xb"), total(above, F.lit(1.0)).alias("na"),
                                        total(above, X).alias("xa"))
        near = stage(joined.where(~below & ~above).groupBy(*each, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")), "near")
        count = near.groupBy(*each).agg(F.sum("_w").alias("_near"), F.count(F.lit(1)).alias("_m"))
        info = stage(pending.join(far, each).join(count, each, "left").withColumn(
            "_part", (F.col("_m") > near_rows) & ~F.col("whole") & (F.col("wider") < 1e6)), "line-sums")
        picked = near.join(info, each).where(~F.col("_part") | (F.rand(seed) < 1.5 * sample_rows / F.col("_m")))
        seed += 1
        new = stage(picked.groupBy(*each).applyInPandas(step, f"{head}, a2 double, b2 double, lo2 double, hi2 double, full boolean"), "line-steps")
        r2 = Y - F.col("a2") - F.col("b2") * X
        slack = 1e-9 * (1 + F.abs("a2"))
        crossed = rows.join(pending.join(new.where("full"), each), keys).where((below & (r2 > slack)) | (above & (r2 < -slack))).select(
            *each, F.lit(True).alias("_crossed")).distinct()
        all_ = pending.join(new, each, "left").join(crossed, each, "left")
        full, moved = F.coalesce("full", F.lit(False)), F.coalesce(~F.col("full") & F.col("a2").isNotNull(), F.lit(False))
        held = full & F.col("_crossed").isNull()
        # Without near rows, or with a row on the other side, the band grows.
        grows = F.col("full").isNull() | F.col("_crossed").isNotNull()
        width = F.when((F.col("hi") > F.col("lo")) & (F.abs(F.col("hi") - F.col("lo")) < float("inf")), F.col("hi") - F.col("lo")).otherwise(1.0)
        nxt = all_.select(
            *each, F.when(held | moved, F.col("a2")).otherwise(F.col("a")).alias("a"), F.when(held | moved, F.col("b2")).otherwise(F.col("b")).alias("b"),
            F.when(moved, F.col("lo2")).when(grows, F.col("lo") - width).otherwise(F.col("lo")).alias("lo"),
            F.when(moved, F.col("hi2")).when(grows, F.col("hi") + width).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("_crossed").isNotNull(), F.col("wider") * 4).otherwise(F.col("wider")).alias("wider"),
            (F.col("full").isNotNull() & ~full & ~moved).alias("whole"), held.alias("done"))
        state = stage(state.where("done").select(*names).unionByName(nxt), "line-state")
    return state.select(*each, "a", "b")


def _band(res: np.ndarray, spread: float) -> tuple[float, float]:
    """Residuals that hold the share ``spread`` of the rows on either side of zero; infinite where there are not that many."""
    res = np.sort(res)
    zero = np.searchsorted(res, 0.0)
    reach = int(np.ceil(spread * len(res)))
    return (float(res[zero - reach]) if zero > reach else -np.inf), (float(res[zero + reach]) if zero + reach < len(res) else np.inf)


def _wide(lo: float, hi: float) -> tuple[float, float]:
    step = hi - lo if np.isfinite(hi - lo) and hi > lo else 1.0
    return lo - step, hi + step


def line(x: Column, params: tuple[float, float]) -> Column:
    return F.lit(params[0]) + F.lit(params[1]) * x
