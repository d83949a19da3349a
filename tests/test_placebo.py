"""Placebo heads dealt over tasks against shuffled columns and sorted scores."""

import pytest
from pyspark.sql import functions as F

from demur.operators import placebo as module
from demur.operators.curves import curve
from demur.operators.lines import pair_heads
from demur.operators.placebo import kept_by_head, placebo_heads
from demur.operators.splits import permute
from demur.plans import QUERIES

NUMBERS = ["ma", "mb", "my", "wa", "wb"]


@pytest.fixture
def rows(spark):
    return spark.range(700).selectExpr("id * 3 AS id", "CAST(pmod(id * 7919, 5) AS INT) AS band", "round(100 * pmod(id * 7919, 997) / 997, 4) AS err",
                                       "CAST(pmod(id * 31, 17) AS DOUBLE) AS spread", "CAST(pmod(id, 4) AS DOUBLE) AS n_lines").repartition(7)


@pytest.mark.parametrize("held", [module.HELD, 90])
def test_heads_equal_those_of_shuffled_columns(rows, monkeypatch, held):
    monkeypatch.setattr(module, "HELD", held)
    got = {(r["kind"], r["placebo"]): r.asDict() for r in placebo_heads(rows, 6, "spread", "n_lines", "err", 1.0).collect()}
    each = rows.withColumn("placebo", F.explode(F.sequence(F.lit(1), F.lit(6))))
    shuffled = lambda kind, within: permute(each, "err", seed=F.col("placebo"), within=within, name="y").withColumn("kind", F.lit(kind))
    real = rows.select("*", F.lit(0).alias("placebo"), F.col("err").alias("y"), F.explode(F.array(F.lit("global"), F.lit("band"))).alias("kind"))
    keep = ["kind", "placebo", "spread", "n_lines", "y"]
    every = shuffled("global", ["placebo"]).select(*keep).unionByName(shuffled("band", ["placebo", "band"]).select(*keep)).unionByName(real.select(*keep))
    want = pair_heads(every, ["kind", "placebo"], "spread", "n_lines", "y", 1.0).collect()
    assert len(want) == len(got) == 14
    for r in want:
        assert [got[r["kind"], r["placebo"]][c] for c in NUMBERS] == pytest.approx([r[c] for c in NUMBERS], rel=1e-9)


@pytest.mark.parametrize("held", [module.HELD, 20])
def test_kept_rows_equal_those_of_sorted_scores(rows, monkeypatch, held):
    monkeypatch.setattr(module, "HELD", held)
    rows = rows.withColumn("units", F.rint(F.col("err") * 10_000).cast("bigint"))
    heads = [{"kind": "global", "placebo": i, "ma": 8.0, "mb": 1.5, "my": 50.0, "wa": i - 1.0, "wb": 0.3 * (i - 2)} for i in range(4)]
    got = {r["placebo"]: (r["k"], r["kept"]) for r in kept_by_head(rows, heads, "spread", "n_lines", "units", 0.9).collect()}
    scores = F.array(*[F.struct(F.lit(h["placebo"]).alias("placebo"), F.round((F.col("spread") - 8) * h["wa"] + (F.col("n_lines") - 1.5) * h["wb"] + 50, 5).alias("score")) for h in heads])
    want = curve(rows.select("id", "band", "units", F.inline(scores)), by=["placebo"], strata=["band"], coverages=[0.9], loss="units").collect()
    assert len(got) == 4 and got == {r["placebo"]: (r["k"], round(r["risk"] * r["k"])) for r in want}


def test_placebo_test_has_the_published_number_of_heads(spark, sf):
    """With 20 heads of each kind p was a multiple of 1/21."""
    got = QUERIES["placebo_test"](spark, sf).collect()
    assert len(got) == 2 and any(r["p"] < 1 for r in got)
    assert all(r["p"] * 201 == pytest.approx(round(r["p"] * 201), abs=1e-3) for r in got)
