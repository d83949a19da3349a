"""Readers, sinks, listings, specs and image metrics on hand-made inputs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.functions.conditions import enumerate_conditions, ladder_table, parse_spec, tag
from demur.functions.expr import significant, stars
from demur.operators.quality import METRICS, measure, to_gray
from demur.sources import facts, features, images, listing, records


def test_ragged_records(spark, tmp_path):
    a = tmp_path / "a.csv"
    b = tmp_path / "b.csv"
    part = "ingr_1,egg, white,5,6,0,0,0"
    a.write_text("\n".join([
        f"dish_1,10,20,1,2,3,{part},ingr_2,short", "dish_2,x,20,1,2,3," + part, "dish_3,1,2,3", "plate_4,1,2,3,4,5",
        'dish_5,1,30,1,1,1,ingr_9,"salt, sea",7,8,0,0,0,ingr_8,oil,bad,1,0,0,0', "dish_6,1,9000,1,1,1"]))
    b.write_text("dish_1,11,21,1,2,3\n")
    one = {r["id"]: r for r in records.parse_records(spark.read.text(str(a))).collect()}
    assert set(one) == {"dish_1", "dish_5", "dish_6"}
    assert [tuple(p) for p in one["dish_1"]["parts"]] == [("egg  white", 5.0, 6.0)]
    assert [tuple(p) for p in one["dish_5"]["parts"]] == [("salt, sea", 7.0, 8.0)]
    both = {r["id"]: r["cal"] for r in records.read_records(spark, [str(a), str(b)]).collect()}
    assert both == {"dish_1": 11.0, "dish_5": 1.0}


def test_lookup_and_ids(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ingr,id,cal/g,fat(g),carb(g),protein(g)\n egg ,1,1.5,1,1,1\nbad,2,x,1,1,1\negg,3,2.5,1,1,1\n")
    got = records.read_lookup(spark, str(tmp_path / "l.csv")).collect()
    assert [(r["name"], r["cal_g"]) for r in got] == [("egg", 2.5)]
    (tmp_path / "ids.txt").write_text(" b \n\na\n")
    assert [r["id"] for r in records.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == ["b", "a"]
    df = spark.createDataFrame([("dish_1551235699",)], "id string")
    assert df.select(records.id_seconds(F.col("id"))).first()[0] == 1551235699


def test_listing(spark, tmp_path):
    objs = spark.createDataFrame([("a/b/c/d1/rgb.png", 5), ("a/b/c/d1/x", 2), ("a/b/c", 1)], "name string, size long")
    assert {tuple(r) for r in listing.roll_up(objs).collect()} == {("d1", "rgb.png", 5), ("d1", "x", 2)}
    (tmp_path / "m.json").write_text('{"id": "d1", "files": {"rgb.png": 5}}\n{"id": "d2", "files": {"x": 1}}\n')
    m = listing.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r["id"] for r in listing.available_ids(m, "rgb.png").collect()] == ["d1"]
    e = spark.createDataFrame([("a", 5), ("b", 0), ("c", 3), ("d", 4)], "id string, size long")
    p = spark.createDataFrame([("a", 5), ("b", 9), ("c", 2), ("z", 1)], "id string, size long")
    assert {r["id"]: r["status"] for r in listing.reconcile(e, p).collect()} == {
        "a": "skip", "b": "skip", "c": "FAIL", "d": "fetch", "z": "extra"}


def test_specs(spark):
    df = spark.createDataFrame([("clean",), ("blur:3+jpeg:40",), ("phone",), ("noise",)], "s string")
    got = [[tuple(x) for x in r[0]] for r in df.select(parse_spec(F.col("s"))).collect()]
    assert got[0] == [] and got[1] == [("blur", 3.0), ("jpeg", 40.0)] and len(got[2]) == 4 and got[3] == [("noise", 0.02)]
    assert df.select(tag(F.lit("crop:0.4"))).first()[0] == "crop0p4"
    assert enumerate_conditions(ladder_table(spark)).count() == 43
    with pytest.raises(Exception, match="unknown condition family"):
        spark.createDataFrame([("fog:1",)], "s string").select(parse_spec(F.col("s"))).collect()


def test_fact_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 123456.789, 0.0), ("b", 0.000123456789, -2.5)], "id string, x double, y double")
    facts.export_text(df, str(tmp_path / "f"))
    back = {r["id"]: r["x"] for r in facts.read_fact(spark, str(tmp_path / "f"), df.schema).collect()}
    assert back == {"a": 123457.0, "b": 0.000123457}
    assert facts.read_fact(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert spark.range(1).select(significant(F.lit(0.0))).first()[0] == 0.0
    assert [spark.range(1).select(stars(F.lit(p))).first()[0] for p in (0.0001, 0.005, 0.04, 0.5)] == ["***", "**", "*", ""]


def test_feature_partitions(spark, tmp_path):
    f = spark.createDataFrame([("a", [1.0], "m", "train", "clean"), ("b", [2.0], "m", "calib", "blur3")],
                              "id string, features array<double>, model string, split string, condition string")
    features.write_features(f, str(tmp_path / "f"))
    got = features.read_features(spark, str(tmp_path / "f"), "m", "train", "clean")
    assert [r["id"] for r in got.collect()] == ["a"]
    want = spark.createDataFrame([("a",), ("c",)], "id string")
    with pytest.raises(KeyError):
        features.require_all(want, f)


def png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_scan_and_metrics(spark, tmp_path):
    rng = np.random.default_rng(0)
    shots = {"solid": np.full((12, 20, 3), 90, np.uint8), "noise": rng.integers(0, 256, (12, 20, 3), dtype=np.uint8),
             "red": np.dstack([np.full((12, 20), v, np.uint8) for v in (200, 50, 100)])}
    for name, px in shots.items():
        png(tmp_path / name / "rgb.png", px)
    assert {r["id"] for r in listing.local_ids(spark, str(tmp_path), "rgb.png").collect()} == set(shots)
    got = {r["id"]: r for r in measure(images.read_images(spark, str(tmp_path))).collect()}
    assert got["red"]["colour_rb"] == pytest.approx(2.0) and got["red"]["saturation"] == pytest.approx(0.75)
    assert got["solid"]["lap_var"] == 0 and got["solid"]["blockiness"] == 0 and np.isnan(got["solid"]["hf_ratio"])
    px = shots["noise"].astype(int)
    g = (px @ [19595, 38470, 7471] + 32768) >> 16
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    assert got["noise"]["lap_var"] == pytest.approx(lap.var())
    assert got["noise"]["brightness"] == pytest.approx(g.mean()) and set(METRICS) <= set(got["noise"].asDict())
    assert (to_gray(shots["noise"]) == g).all()
