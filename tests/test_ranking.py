"""The bucketed path must equal a plain window, whatever the ties and the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from demur.operators import ranking
from demur.operators.curves import COVERAGES, curve
from demur.operators.sessions import sessionize, with_gap


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    g = rng.choice(["hot", "cold", "tiny"], n, p=[0.7, 0.298, 0.002])
    s = np.where(rng.random(n) < 0.35, 1.5, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": g, "id": np.arange(n), "s": s, "v": np.round(rng.random(n) * 100, 3), "m": rng.integers(0, 4, n)})
    return spark.createDataFrame(pdf).repartition(4).persist()


def frame(df, cols):
    return df.toPandas().sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_equals_window(rows, keys):
    assert ranking.find_splits(rows, keys, ["s", "id"], 100) is not None
    got = frame(ranking.running(rows, ["s", "id"], keys, {"cs": "v"}, size="n", rows_per_bucket=100), ["id"])
    w = Window.partitionBy(*keys).orderBy("s", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = frame(rows.withColumn("rank", F.row_number().over(w)).withColumn("cs", F.sum("v").over(w))
                 .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))), ["id"])
    assert (got["rank"] == want["rank"]).all() and (got["n"] == want["n"]).all()
    np.testing.assert_allclose(got["cs"], want["cs"])
    assert list(got.columns) == list(want.columns)


def test_weighted_take_at_equals_replicated_rows(rows):
    copies = rows.filter("m > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("m"))))
    order = ["s", "id"]
    split = ranking.find_splits(rows, ["g"], order, 100)
    t = ranking.coverage_targets(COVERAGES)
    a = frame(ranking.take_at(rows, ["g"], order, t, {"kept": "v"}, weight="m", splits=split), ["g", "coverage"])
    b = frame(ranking.take_at(copies, ["g"], order + ["c"], t, {"kept": "v"}), ["g", "coverage"])
    assert len(a) == 3 * 19
    assert (a["k"] == b["k"]).all() and (a["n"] == b["n"]).all() and (a["id"] == b["id"]).all()
    np.testing.assert_allclose(a["kept"], b["kept"])


def test_plain_and_bucketed_curves_agree(rows):
    r = rows.withColumnsRenamed({"g": "gate", "s": "score", "v": "err"}).withColumn("band", F.col("id") % 3)
    for strata in ([], ["band"]):
        a = frame(curve(r, strata=strata, rows_per_bucket=150), ["gate", "coverage"])
        b = frame(curve(r, strata=strata), ["gate", "coverage"])
        assert (a["k"] == b["k"]).all()
        np.testing.assert_allclose(a["risk"], b["risk"])


def test_quantiles_equal_numpy(rows):
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    pdf = rows.toPandas()
    for size in (None, 100):
        got = frame(ranking.quantiles(rows, ["g"], "s", probs, rows_per_bucket=size), ["g", "prob"])
        want = [np.quantile(pdf.s[pdf.g == g], p) for g in sorted(pdf.g.unique()) for p in probs]
        np.testing.assert_allclose(got["value"], want)


def test_order_statistic_clamps(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", 4.0)], "g string, s double")
    got = {r["g"]: (r["k"], r["q"]) for r in ranking.order_statistic(df, ["g"], "s", 0.1).collect()}
    assert got == {"a": (9, 8.0), "b": (1, 4.0)}


def test_half_even_kept_count(spark):
    df = spark.createDataFrame([("x", i, float(i), 1.0) for i in range(10)], "gate string, id int, score double, err double")
    ks = {r["coverage"]: r["k"] for r in curve(df, coverages=[0.25, 0.75, 0.01]).collect()}
    assert ks == {0.25: 2, 0.75: 8, 0.01: 1}


def test_nan_scores_sort_last_in_both_paths(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 3 == 0 else float(i)) for i in range(400)], "id int, s double")
    a = frame(ranking.running(df, ["s", "id"], rows_per_bucket=40), ["id"])
    b = frame(ranking.running(df, ["s", "id"]), ["id"])
    assert (a["rank"] == b["rank"]).all()


def test_session_gap_is_strict_and_bucketed_path_agrees(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 600.0), (3, 1201.0)], "id int, t double")
    assert [r["session"] for r in sessionize(df, "t", "id").orderBy("id").collect()] == [0, 0, 1]
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"u": rng.choice(["a", "b"], 1500, p=[0.8, 0.2]), "id": range(1500), "t": np.sort(rng.random(1500) * 1e5)})
    big = spark.createDataFrame(pdf)
    for keys in ([], ["u"]):
        a = frame(sessionize(big, "t", "id", keys, 100.0, rows_per_bucket=60), ["id"])
        b = frame(sessionize(big, "t", "id", keys, 100.0), ["id"])
        assert (a["session"] == b["session"]).all()
        x, y = frame(with_gap(big, "t", "id", keys, rows_per_bucket=60), ["id"]), frame(with_gap(big, "t", "id", keys), ["id"])
        np.testing.assert_allclose(x["gap"], y["gap"])


@pytest.mark.parametrize("strata", [[], ["band"]])
def test_replicated_curves_equal_weighted_windows(rows, strata):
    from demur.operators.replicate import kept_by_replicate
    from demur.operators.resample import multiplicities
    r = rows.withColumnsRenamed({"g": "gate", "s": "score", "v": "err"}).withColumn("band", F.col("id") % 3).withColumn(
        "cluster", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40)).drop("m")
    mult = multiplicities(r.select("cluster"), 7, with_point=True).persist()
    keys = ["gate", *strata]
    t = ranking.coverage_targets([1.0, 0.9, 0.5, 0.1])
    want = frame(ranking.take_at(r.join(mult, "cluster"), ["b", *keys], ["score", "id"], t, {"kept": "err"}, weight="m"), ["b", *keys, "coverage"])
    for size in (None, 120):
        got = frame(kept_by_replicate(r, mult, keys, "score", "err", "id", [1.0, 0.9, 0.5, 0.1], batch=3, rows_per_bucket=size),
                    ["b", *keys, "coverage"])
        assert len(got) == len(want) and (got["k"] == want["k"]).all()
        np.testing.assert_allclose(got["kept"], want["kept"])
