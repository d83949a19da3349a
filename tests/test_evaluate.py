"""Invariants of splits, curves, tests and ranges on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.operators.assess import auc, spearman
from demur.operators.curves import aurc, curve, random_curve, with_perfect
from demur.operators.evaluate import holm
from demur.operators.lines import MOMENTS, merge_moments, moments, without
from demur.operators.resample import multiplicities
from demur.operators.splits import carve, cluster_sizes, deal_by_size
from demur.plans import ORACLES, QUERIES
from demur.plans.views import GATES, calib_rows, test_long as long_rows, test_rows as rows_of
from demur.operators.ranges import calibrate


def test_curve_invariants(spark, sf):
    rows = with_perfect(long_rows(spark, sf), GATES[0])
    got = curve(rows).toPandas().pivot(index="coverage", columns="gate", values="risk")
    flat = random_curve(rows_of(spark, sf)).first()["risk"]
    np.testing.assert_allclose(got.loc[1.0], flat)
    assert (got.sub(got["perfect"], axis=0) >= -1e-6).all().all()
    assert got["perfect"].is_monotonic_increasing
    one = curve(rows.withColumn("s", F.lit(0)), strata=["s"]).toPandas().pivot(index="coverage", columns="gate", values="risk")
    np.testing.assert_allclose(one, got)
    area = {r["gate"]: r["aurc"] for r in aurc(curve(rows)).collect()}
    assert area["perfect"] == min(area.values())


def test_carve_and_folds_keep_clusters(spark, sf):
    rows = rows_of(spark, sf)
    sizes = cluster_sizes(rows)
    c = carve(sizes).collect()
    n = sum(r["size"] for r in c)
    held = sum(r["size"] for r in c if r["calib"])
    assert 0.3 * n <= held < 0.3 * n + max(r["size"] for r in c)
    folds = deal_by_size(sizes, 5)
    assert folds.count() == sizes.count() and {r["fold"] for r in folds.collect()} == set(range(5))
    mult = multiplicities(rows.select("cluster"), 4).groupBy("b").agg(F.sum("m").alias("m")).collect()
    assert [r["m"] for r in mult] == [sizes.count()] * 4


def test_holm_steps(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.9, "e": 0.9}
    df = spark.createDataFrame([("f", k, v) for k, v in p.items()], "coverage string, gate string, p double")
    got = {r["gate"]: r["p_holm"] for r in holm(df, ["coverage"]).collect()}
    assert got["a"] == pytest.approx(0.05) and got["c"] == pytest.approx(0.12) and got["b"] == pytest.approx(0.12)
    assert got["d"] == got["e"] == 1.0 and all(got[k] >= v for k, v in p.items())


def test_spearman_and_auc(spark):
    df = spark.createDataFrame([("g", i, float(i), float(-i), i > 5) for i in range(10)], "g string, id int, a double, b double, p boolean")
    assert spearman(df, ["g"], "a", "b").first()["rho"] == pytest.approx(-1)
    assert auc(df, ["g"], "a", "p").first()["auc"] == 1.0 and auc(df, ["g"], "b", "p").first()["auc"] == 0.0
    assert auc(df.withColumn("a", F.lit(1.0)), ["g"], "a", "p").first()["auc"] == 0.5


def test_moment_subtraction(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i % 3, float(x), float(2 * x + e)) for i, (x, e) in enumerate(rng.normal(50, 9, (90, 2)))],
                                 "f int, x double, y double")
    m = moments(rows, ["f"], "x", "y")
    total = merge_moments(m, []).select(F.struct(*MOMENTS).alias("t"))
    got = m.filter("f = 1").select(F.struct(*MOMENTS).alias("p")).join(total).select(*without("t", "p")).first()
    want = moments(rows.filter("f <> 1"), [], "x", "y").first()
    np.testing.assert_allclose([got[c] for c in MOMENTS], [want[c] for c in MOMENTS])


def test_calibration_covers_itself(spark, sf):
    rows = calib_rows(spark, sf)
    q = calibrate(rows, F.col("err")).first()["q"]
    assert rows.select(F.avg((F.col("err") <= q).cast("double"))).first()[0] >= 0.9


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 110


def test_entry_has_rows(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 8 * 19


def test_block_has_every_step_of_the_method(spark, sf):
    """Areas had no interval, and rank correlations, shares of the gap, what is kept and pairs of gates were missing."""
    rows = QUERIES["eval_block"](spark, sf, 50).collect()
    pairs = [r for r in rows if " - " in r["gate"]]
    assert len(pairs) == 12 and all(r["diff"] is not None and r["p"] is not None for r in pairs)
    gates = [r for r in rows if " - " not in r["gate"]]
    assert {r["gate"] for r in gates} == {*GATES, "random", "perfect"}
    for r in gates:
        assert r["aurc_lo"] <= r["aurc_hi"] and r["share_lo"] <= r["share_hi"] and r["rho_lo"] <= r["rho_hi"]
        assert (r["rho_size"] is None) == (r["gate"] == "random") and (r["kept_mean"] is None) == (r["coverage"] not in (0.9, 0.5))
    assert {(r["gap_share"], r["rho"], r["share_lo"]) for r in gates if r["gate"] == "perfect"} == {(1.0, 1.0, 1.0)}
    assert {(r["gap_share"], r["rho"], r["rho_hi"]) for r in gates if r["gate"] == "random"} == {(0.0, 0.0, 0.0)}
