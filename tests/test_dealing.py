"""Rows that are dealt once for all that follows, over tasks of a bounded number of rows."""

import re

import pytest
from pyspark.sql import functions as F

from demur.functions.draws import uniform
from demur.operators.lookup import perturbed_errors, priors
from demur.plans.views import _conditional_predictions, vocab
from demur.sources.staging import deal


def exchanges(df, by: str) -> int:
    return len(re.findall(rf"Exchange hashpartitioning\({by}#", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_travel_by_order_once(spark, sf, shuffled_joins):
    vocab(spark, sf)
    assert exchanges(_conditional_predictions(spark, sf), "id") == 2  # lines and orders


def test_more_rows_make_more_tasks_and_aggregates_stay(spark, monkeypatch):
    monkeypatch.setattr("demur.sources.staging.TASK_ROWS", 10)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    assert deal(rows, 1000, "id").rdd.getNumPartitions() == deal(rows, 1000, "id", ordered=True).rdd.getNumPartitions() == 100
    assert exchanges(deal(rows, 1000, "id").groupBy("id", "k").count(), "id") == 1


def test_priors_of_dealt_parts(spark, monkeypatch):
    monkeypatch.setattr("demur.sources.staging.TASK_ROWS", 10)
    parts = spark.range(900).select((F.col("id") % 40).alias("name"), (F.col("id") % 11).cast("double").alias("grams"), (F.col("id") * 3.7).alias("amount"))
    parts = parts.unionByName(parts.limit(9).withColumn("name", F.lit(None).cast("long")))
    want = {tuple(r) for r in priors(parts, decimals=4).collect()}
    dealt = priors(parts, decimals=4, rows=909)
    assert {tuple(r) for r in dealt.collect()} == want and len(want) == 41


def shuffled_records(spark) -> int:
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_draws_that_swap_travel(spark, monkeypatch):
    parts = spark.range(400).select((F.col("id") % 100).alias("id"), F.floor(F.col("id") / 100).alias("pos"), (F.col("id") * 7 % 30).alias("name"))
    # One name is unknown, and another counts for nothing.
    names = spark.range(29).select(F.col("id").alias("name"), (F.col("id") * 1.5).alias("density"), F.when(F.col("id") == 4, 0.0).otherwise(F.col("id") / 10).alias("typical"))
    items = spark.range(100).select("id", (F.col("id") * 3.0).alias("truth"), (F.col("id") + 1.0).alias("mass"))
    run = lambda: {(r["mass_err"], r["name_err"]): r["mae"] for r in perturbed_errors(
        parts, items, names, 9.0, [(0.0, 0.0), (0.1, 0.1), (0.1, 0.0)], 60, "pos", count=400).collect()}
    want = run()
    monkeypatch.setattr("demur.operators.lookup.BROADCAST_NAMES", 0)
    monkeypatch.setattr("demur.sources.staging.TASK_ROWS", 200)
    before = shuffled_records(spark)
    assert run() == pytest.approx(want, abs=1e-9)
    # 24,000 draws, of which one in ten swaps.
    assert 0 < shuffled_records(spark) - before < 15_000

    # Brute force over the same draws.
    draw = lambda what, *by: uniform(what, 760, *[F.col(c) for c in by])
    each = parts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(60)))).select(
        "id", "pos", "name", "rep", draw("swap", "rep", "id", "pos").alias("swap"), draw("pick", "rep", "id", "pos").alias("pick"), draw("mass", "rep", "id").alias("mass")).collect()
    known = {r["name"]: (r["density"], r["typical"]) for r in names.collect()}
    sums: dict[tuple, list] = {}
    for r in each:
        d, t = known[int(r["pick"] * 29)] if r["swap"] < 0.1 else known.get(r["name"], (0.0, 0.0))
        s = sums.setdefault((r["rep"], r["id"]), [0.0, 0.0, r["mass"]])
        s[0], s[1] = s[0] + t, s[1] + t * d
    errors = [abs((td / t * (i + 1) * (1 + 0.1 * (4 * m - 2)) if t > 0 else 9.0) - 3 * i) for (_, i), (t, td, m) in sums.items()]
    assert want[0.1, 0.1] == pytest.approx(sum(errors) / len(errors), abs=1e-9)
