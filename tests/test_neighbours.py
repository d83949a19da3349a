"""Nearest rows by pivots against brute force, and how many cells are visited."""

import tracemalloc

import numpy as np
import pytest

from demur.operators.neighbours import _centres, _to_centres, broadcast_fit, homes, knn_distance, nearest_by_pivots, nearest_squares, part_rows, visits

SCHEMA = "id long, x array<double>"


def clustered(n=1500, d=8, spread=0.05):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, d))
    return centres[draw.integers(12, size=n)] + spread * draw.normal(size=(n, d))


def brute(q, f, k):
    return np.sort(np.sqrt(((q[:, None, :] - f[None]) ** 2).sum(2)), 1)[:, :k]


@pytest.mark.parametrize("x", [clustered(), np.random.default_rng(1).normal(size=(900, 8)), np.repeat(clustered(20), 40, axis=0)])
def test_nearest_by_pivots_equals_brute_force(spark, x):
    frame = lambda rows: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    q, f = frame(x[:300]), frame(x)
    near = nearest_by_pivots(q.withColumnRenamed("id", "key"), f.select("x"), 7, block_rows=40, chunk_rows=64)
    got = {}
    for r in near.collect():
        got.setdefault(r["key"], []).append(r["d2"])
    assert len(got) == 300
    np.testing.assert_allclose([sorted(got[i]) for i in range(300)], brute(x[:300], x, 7) ** 2, atol=1e-9)


def test_few_fit_rows_repeated_ids_and_nothing(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])], SCHEMA)
    fit = spark.createDataFrame([(9, [0.0, 0.0]), (8, [6.0, 8.0])], SCHEMA)
    assert sorted((r["id"], r["knn_dist"]) for r in knn_distance(q, fit, "x", "id", k=5).collect()) == [(1, 5.0), (1, 5.0), (2, 5.0)]
    assert knn_distance(q, fit.limit(0), "x", "id").count() == 0 and knn_distance(q.limit(0), fit, "x", "id").count() == 0


def test_clustered_rows_visit_few_cells():
    x = clustered(20_000)
    centres = _centres(x[:4000], 200)
    d = _to_centres(x, centres)
    at = d.argmin(1)
    counts = np.bincount(at, minlength=200)
    least, most = np.full(200, np.inf), np.full(200, -np.inf)
    np.minimum.at(least, at, d.min(1))
    np.maximum.at(most, at, d.min(1))
    q = d[:500]
    home = homes(q, counts, 10)
    bound = np.array([np.sort(np.sqrt(((x[i] - x[home[i][at]]) ** 2).sum(1)))[9] for i in range(500)])
    visited = (visits(q, bound, least, most) | home) @ counts
    assert visited.mean() < 0.1 * len(x)


@pytest.mark.parametrize("x", [clustered(9000), np.repeat(clustered(30), 300, axis=0), np.random.default_rng(2).normal(size=(4100, 8)), clustered(6)])
def test_nearest_squares_over_parts_equals_brute_force(x):
    q = x[:150]
    np.testing.assert_allclose(nearest_squares(q, x, 7), brute(q, x, 7) ** 2, atol=1e-9)
    np.testing.assert_allclose(nearest_squares(q, iter([x[:5], x[5:5], x[5:]]), 7), brute(q, x, 7) ** 2, atol=1e-9)


def test_memory_does_not_grow_with_the_fit_rows():
    draw, peaks = np.random.default_rng(5), []
    q = draw.normal(size=(2048, 8))
    for n in (4 * part_rows(8), 16 * part_rows(8)):
        fit = draw.normal(size=(n, 8))
        tracemalloc.start()
        nearest_squares(q, fit, 10)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 200e6


def test_fit_rows_are_held_in_files(spark):
    x = clustered(700)
    fit = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(5)
    held = broadcast_fit(fit, "x")
    assert sorted(map(tuple, np.vstack(list(held.parts())))) == sorted(map(tuple, x))
    assert broadcast_fit(fit, "x", 700 * 8 * 8 - 1) is None
    got = {r["id"]: r["knn_dist"] for r in knn_distance(fit, fit, "x", "id", broadcast_bytes=1 << 20).collect()}
    np.testing.assert_allclose([got[i] for i in range(700)], brute(x, x, 10).mean(1), atol=1e-6)
