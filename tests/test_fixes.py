"""Rows that earlier versions got wrong: nulls, repeated ids, ties, split groups, odd records and images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.operators import assess, quantreg
from demur.operators.curves import curve
from demur.operators.gates import fit_gates
from demur.operators.lookup import priors
from demur.operators.quality import measure
from demur.operators.ranges import by_bin
from demur.operators.ranking import quantiles
from demur.operators.replicate import kept_by_replicate
from demur.operators.resample import mean_interval, multiplicities, replicate_means
from demur.sources import features, listing, records


def test_gates_score_every_row_of_an_id(spark, monkeypatch):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 4))
    rows = [(i, v.tolist(), float(v[0] + 1), "c") for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "id long, f array<double>, y double, condition string")
    fitted = fit_gates(table.filter("id < 40"), table.filter("id >= 40"), "f", ["y"], "id", replicates=3, components=2)
    two = table.unionByName(table.withColumn("condition", F.lit("d")).withColumn("f", F.transform("f", lambda v: v + 1)))
    got = {(r["id"], r["condition"]): r["knn_dist"] for r in fitted.score(two).collect()}
    assert len(got) == fitted.score(two).count() == 120
    monkeypatch.setattr("demur.operators.neighbours.BROADCAST_BYTES", 0)
    fitted._held = (None,)
    monkeypatch.setattr("demur.operators.neighbours.broadcast_fit", lambda *a: None)
    large = {(r["id"], r["condition"]): r["knn_dist"] for r in fitted.score(two).collect()}
    assert large.keys() == got.keys() and all(np.isclose(large[k], got[k]) for k in got)


def test_null_cluster_is_a_cluster(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"c{i % 4}", float(i)) for i in range(40)], "id long, cluster string, v double")
    mult = multiplicities(rows, 60)
    assert {r["n"] for r in mult.groupBy("b").agg(F.sum("m").alias("n")).collect()} == {4}
    assert mult.select("cluster").distinct().count() == 4
    point = multiplicities(rows, 2, with_point=True)
    assert replicate_means(rows, point.filter("b = 0"), F.col("v")).first()["value"] == pytest.approx(19.5)
    assert mean_interval(rows, mult, F.col("v")).first()["lo"] < 19.5


@pytest.mark.parametrize("rows_per_bucket", [None, 10])
def test_null_and_nan_scores_have_one_place(spark, rows_per_bucket):
    score = [None, float("nan")] + [float(i % 5) for i in range(58)]
    rows = spark.createDataFrame([(i, f"c{i % 6}", s, float(i)) for i, s in enumerate(score)], "id long, cluster string, score double, err double").withColumn("gate", F.lit("g"))
    mult = multiplicities(rows, 3, with_point=True)
    kept = kept_by_replicate(rows, mult, ["gate"], "score", "err", "id", [0.25, 0.5, 1.0], rows_per_bucket=rows_per_bucket)
    got = {r["coverage"]: r["kept"] / r["k"] for r in kept.filter("b = 0").collect()}
    want = {r["coverage"]: r["risk"] for r in curve(rows, coverages=[0.25, 0.5, 1.0]).collect()}
    assert got == pytest.approx(want)


def test_quantile_regression_on_ties():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n = int(draw.integers(2, 9))
        x, y, tau = draw.integers(0, 4, n).astype(float), draw.integers(0, 4, n).astype(float), float(draw.choice([0.1, 0.5, 0.75, 0.9]))
        loss = lambda a, b: np.sum(np.maximum(tau * (y - a - b * x), (tau - 1) * (y - a - b * x)))  # noqa: B023, E731
        lines = [(y[i], 0.0) for i in range(n)] + [quantreg._through(x, y, i, j) for i in range(n) for j in range(n)]
        assert loss(*quantreg.solve(x, y, tau)) <= min(loss(*l) for l in lines) + 1e-9


def test_quantile_regression_of_many_rows_by_shrinking(spark):
    table = spark.range(6000).select((F.col("id") % 97).cast("double").alias("x"), (F.rand(3) * 10 + F.col("id") % 97).alias("y")).cache()
    p = table.toPandas()
    want = quantreg.solve(p["x"].to_numpy(), p["y"].to_numpy(), 0.8)
    assert quantreg.fit(table, "x", "y", 0.8) == pytest.approx(want, abs=1e-6)
    assert quantreg.fit(table, "x", "y", 0.8, sample_rows=300, near_rows=100) == pytest.approx(want, abs=1e-6)
    same = spark.range(3000).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    a, b = quantreg.fit(same, "x", "y", 0.9, sample_rows=100, near_rows=1)
    assert a + b == 1.0


@pytest.mark.parametrize("rows_per_bucket", [50, 400])
def test_split_quantiles_of_ties_and_nulls(spark, rows_per_bucket):
    table = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 501).cast("double")).alias("v"), (F.col("id") % 2).alias("g"))
    got = {(r["g"], r["prob"]): r["value"] for r in quantiles(table, ["g"], "v", [0.1, 0.5, 0.93], rows_per_bucket).collect()}
    p = table.toPandas()
    assert got == pytest.approx({(k, q): np.quantile(p[p.g == k].v, q) for k in (0, 1) for q in (0.1, 0.5, 0.93)})


def test_test_split_must_exist(spark):
    feats = spark.createDataFrame([(1, "train", [1.0])], "id long, split string, features array<double>")
    with pytest.raises(FileNotFoundError):
        features.with_fallback(spark.range(1), feats, "test")


def test_record_numbers_and_file_order(spark, tmp_path):
    part = "ingr_1,salt,1,2,0,0,0"
    (tmp_path / "a.txt").write_text(f"dish_1,1,1,1,1,1,{part}\ndish_2,5d,1,1,1,1,{part}\ndish_1,2,1,1,1,1,{part}\ndish_3,1e1, 2 ,.5,-1,1.,{part}\ndish_4,1,1,1,1,1,ingr_2,x,1f,2,0,0,0\n")
    (tmp_path / "b.txt").write_text(f"dish_9,3,1,1,1,1,{part}\n")
    got = {r["id"]: r for r in records.read_records(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], False).collect()}
    assert set(got) == {"dish_1", "dish_3", "dish_4", "dish_9"} and got["dish_1"]["cal"] == 2.0 and got["dish_3"]["cal"] == 10.0
    assert got["dish_4"]["parts"] == []


def test_gray_image(spark):
    gray = bytes(range(64)) * 4
    colour = bytes(v for v in gray for _ in range(3))
    table = spark.createDataFrame([(16, 16, bytearray(gray)), (16, 16, bytearray(colour))], "height int, width int, data binary")
    one, three = measure(table).drop("data").collect()
    assert one == three


def test_small_things(spark):
    parts = spark.createDataFrame([("a", 3.0, 0.0001)], "name string, grams double, amount double")
    assert priors(parts).first()["density"] == pytest.approx(0.0001 / 3)
    objs = spark.createDataFrame([("x/y/z/d1/f", 9, 1), ("x/y/z/d1/f", 4, 2)], "name string, size long, at long")
    assert listing.roll_up(objs, order="at").first()["size"] == 4
    assert tuple(listing.total_bytes(listing.roll_up(objs), "f").first()) == (1, 9)
    there = spark.createDataFrame([("f", 4)], "id string, size long")
    wanted = spark.createDataFrame([("f", None)], "id string, size long")
    assert listing.reconcile(wanted, there).first()["status"] == "skip"
    calib = spark.createDataFrame([(float(i), 1.0) for i in range(8)], "pred double, err double")
    test = spark.createDataFrame([(1, 99.0)], "id long, pred double")
    got = by_bin(test, calib.filter("pred < 4"), "m", ["id"], at=[2.0, 4.0, 6.0]).first()
    assert got["hi"] == float("inf") and got["lo"] == 0.0
    big = spark.createDataFrame([(0.0, True), (1.0, False)], "v double, p boolean").join(spark.range(3))
    assert assess.auc(big, [], "v", "p").first()["auc"] == 0.0
