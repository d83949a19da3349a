"""Statistics, ridge, distances and quantile regression against numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest

from demur.operators import quantreg
from demur.operators.gates import fit_gates, row_multiplicities
from demur.operators.neighbours import knn_distance
from demur.operators.stats import ALPHA_GRID, gram, pick_alpha


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(240, 4)) * [1, 10, 0.1, 3] + [0, 5, 100, -2]
    y = X @ [1, -0.5, 3, 0] + rng.normal(size=240)
    return X, y, np.where(np.arange(240) % 3 == 0, "c", "f")


@pytest.fixture(scope="module")
def frame(spark, data):
    X, y, role = data
    pdf = pd.DataFrame({"id": range(240), "x": list(X), "y": y, "y2": y * 2 + 1, "role": role, "fold": np.arange(240) % 4})
    pdf["x"] = [[float(v) for v in r] for r in X]
    schema = "id long, x array<double>, y double, y2 double, role string, fold long"
    return spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), schema).repartition(5).persist()


def ridge(X, y, alpha):
    Xc = X - X.mean(0)
    return np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ (y - y.mean()))


def test_gram_ridge_and_fold_subtraction(frame, data):
    X, y, _ = data
    st = gram(frame, "x", ["y", "y2"])[None]
    np.testing.assert_allclose(st.mx, X.mean(0))
    np.testing.assert_allclose(st.sd, X.std(0))
    np.testing.assert_allclose(st.ridge(3.0), np.column_stack([ridge(X, y, 3.0), ridge(X, 2 * y + 1, 3.0)]), rtol=1e-7)
    folds = gram(frame, "x", ["y"], key="fold")
    assert set(folds) == {"0", "1", "2", "3"}
    total = folds["0"] + folds["1"] + folds["2"] + folds["3"]
    keep = np.arange(240) % 4 != 2
    np.testing.assert_allclose((total - folds["2"]).ridge(1.0)[:, 0], ridge(X[keep], y[keep], 1.0), rtol=1e-6)


def test_weighted_gram_equals_repeated_rows(frame, data):
    X, y, _ = data
    m = row_multiplicities(frame.select("id", "x", "y"), "id", 3)
    p = m.select("id", "mult").toPandas().sort_values("id")
    W = np.vstack(p["mult"])
    assert (W.sum(0) == 240).all()
    got = gram(m, "x", ["y"], weights="mult")
    for b in range(3):
        idx = np.repeat(np.arange(240), W[:, b].astype(int))
        np.testing.assert_allclose(got[b].ridge(2.0)[:, 0], ridge(X[idx], y[idx], 2.0), rtol=1e-6)


def test_alpha_grid_first_best(frame, data):
    X, y, role = data
    f, c = role == "f", role == "c"
    st = gram(frame.filter("role = 'f'"), "x", ["y"])[None]
    alpha, mae = pick_alpha(st, frame.filter("role = 'c'"), "x", "y")
    want = [np.abs((X[c] - X[f].mean(0)) @ ridge(X[f], y[f], a) + y[f].mean() - y[c]).mean() for a in ALPHA_GRID]
    np.testing.assert_allclose(mae, want, rtol=1e-7)
    assert alpha == ALPHA_GRID[int(np.argmin(want))]


def test_gates_equal_numpy(frame, data):
    X, y, role = data
    f, c = role == "f", role == "c"
    g = fit_gates(frame.filter("role = 'f'"), frame.filter("role = 'c'"), "x", ["y", "y2"], "id", replicates=4, components=3)
    got = g.score(frame.filter("role = 'c'")).toPandas().sort_values("id")
    z = (X - X[f].mean(0)) / (X[f].std(0) + 1e-8)
    pred = z[c] @ ridge(z[f], y[f], g.alphas[0]) + y[f].mean()
    np.testing.assert_allclose(got["pred0"], pred, rtol=1e-6)
    _, S, Vt = np.linalg.svd(z[f] - z[f].mean(0), full_matrices=False)
    dist = np.sqrt((((z[c] - z[f].mean(0)) @ Vt[:3].T) ** 2 / (S[:3] ** 2 / (f.sum() - 1))).sum(1))
    np.testing.assert_allclose(got["mahalanobis"], dist, rtol=1e-6)
    d = np.sqrt(((z[c][:, None] - z[f][None]) ** 2).sum(2))
    knn = np.sort(d, 1)[:, :10].mean(1)
    np.testing.assert_allclose(got["knn_dist"], knn, rtol=1e-6)
    err = np.abs(pred - y[c])
    le = (z[c] - z[c].mean(0)) @ ridge(z[c], err, g.alphas[0]) + err.mean()
    np.testing.assert_allclose(got["learned_error"], le, rtol=1e-5)
    four = got[["mahalanobis", "knn_dist", "ensemble_spread", "learned_error"]].to_numpy()
    np.testing.assert_allclose(got["blend"], (four - four.mean(0)) @ ridge(four, err, 1.0) + err.mean(), rtol=1e-5)


def test_knn_blocks_equal_broadcast(frame):
    fit = frame.filter("role = 'f'")
    a = knn_distance(frame, fit, "x", "id").toPandas().sort_values("id")
    b = knn_distance(frame, fit, "x", "id", broadcast_bytes=0, block_rows=50).toPandas().sort_values("id")
    assert len(b) == 240
    np.testing.assert_allclose(a["knn_dist"], b["knn_dist"], atol=1e-6)


def brute_loss(x, y, tau):
    best = np.inf
    for i, j in itertools.combinations(range(len(x)), 2):
        if x[i] != x[j]:
            b = (y[j] - y[i]) / (x[j] - x[i])
            r = y - (y[i] - b * x[i]) - b * x
            best = min(best, np.maximum(tau * r, (tau - 1) * r).sum())
    return best


@pytest.mark.parametrize("tau", [0.05, 0.5, 0.95])
def test_quantile_regression_is_optimal(tau):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=60) if seed % 2 else rng.integers(0, 6, 60).astype(float)
        y = 2 * x + rng.gumbel(size=60) * (1 + np.abs(x))
        a, b = quantreg.solve(x, y, tau)
        r = y - a - b * x
        assert np.maximum(tau * r, (tau - 1) * r).sum() <= brute_loss(x, y, tau) * (1 + 1e-9)


def test_quantile_regression_distributed_equals_local(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2, 100, 6000)
    y = x * (1 + 0.3 * rng.normal(size=6000)) + rng.normal(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(4)
    for tau in (0.05, 0.95):
        a, b = quantreg.fit(df, "x", "y", tau, sample_rows=500)
        a0, b0 = quantreg.solve(x, y, tau)
        loss = lambda a, b: np.maximum(tau * (y - a - b * x), (tau - 1) * (y - a - b * x)).sum()
        assert abs(loss(a, b) / loss(a0, b0) - 1) < 1e-9
        assert abs(((y - a - b * x) < 0).mean() - tau) <= 2 / 6000 + 1e-12


def test_keys_are_solved_on_executors(spark, frame):
    from demur.operators.stats import on_each
    solve = lambda s: {"w": s.ridge(2.0)[:, 0], "n": s.n}
    schema = "w array<double>, n double"
    each = {r["key"]: r for r in on_each(frame, "x", ["y"], solve, schema, key="fold").collect()}
    rest = {r["key"]: r for r in on_each(frame, "x", ["y"], solve, schema, key="fold", leave_out=True).collect()}
    pdf = frame.toPandas()
    assert set(each) == set(rest) == set(pdf["fold"].astype(str))
    for k in each:
        for got, part in ((each[k], pdf[pdf["fold"].astype(str) == k]), (rest[k], pdf[pdf["fold"].astype(str) != k])):
            x, y = np.vstack(part["x"]), part["y"].to_numpy(float)
            c = x - x.mean(0)
            np.testing.assert_allclose(got["w"], np.linalg.solve(c.T @ c + 2.0 * np.eye(x.shape[1]), c.T @ (y - y.mean())), atol=1e-8)
            assert got["n"] == len(part)


def test_odd_first_rows_do_not_spoil_the_point_subtracted(spark):
    rows = [([float("inf"), 1.0], 0.0), ([1.0, 2.0], 1.0)]
    from demur.operators.stats import _shift
    assert _shift(spark.createDataFrame(rows, "x array<double>, y double").coalesce(1), "x", ["y"])[0].tolist() == [1.0, 2.0]


def test_row_bootstrap_splits_all_draws():
    from demur.operators.gates import LEAF, leaf_draws
    n = 5 * LEAF + 77
    draws = np.concatenate([leaf_draws(i, n, 6, 1) for i in range(6)], axis=1)
    assert draws.shape == (6, n) and (draws.sum(1) == n).all()
    assert abs(draws.var() - 1) < 0.05 and abs((draws == 0).mean() - np.exp(-1)) < 0.01
    assert np.corrcoef(draws[0], draws[1])[0, 1] < 0.05
