"""Running sums that are right in their last digit."""

import numpy as np
import pytest

from demur.operators import ranking
from demur.operators.lookup import priors
from demur.plans import q_curves, q_refits


@pytest.mark.parametrize("per_bucket", [None, 20_000])
def test_global_prefix_adds_up_exactly(spark, monkeypatch, per_bucket):
    rows = spark.range(200_000).selectExpr("id", "'clean' AS condition", "CAST(id AS DOUBLE) AS pred", "round(400000 + pmod(id * 7919, 99991) / 10000 + 0.0001, 4) AS err")
    monkeypatch.setattr(q_curves, "fact", lambda spark, sf: rows)
    if per_bucket:
        monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", per_bucket)
    got = q_curves.global_prefix(spark, "").orderBy("id").toPandas()
    err = rows.orderBy("id").toPandas()["err"].to_numpy()
    assert got["rank"].tolist() == list(range(1, 200_001))
    assert (got["running_err"].to_numpy() == np.cumsum(np.rint(err * 1e4).astype(np.int64)) / 1e4).all()


def test_median_is_rounded_as_the_mean_of_the_middle_two(spark):
    """1287.5325 and 4961.178 have the mean 3124.35525, which the way over their difference puts just below the half."""
    parts = spark.createDataFrame([("a", 1.0, 1287.5325), ("a", 1.0, 4961.178)], "name string, grams double, amount double")
    assert priors(parts, decimals=4).first()["density"] == 3124.3553


def test_equal_placebo_effects_are_ties_without_a_spread(spark, monkeypatch):
    """All heads keep the same rows, as scores do not depend on the errors; sums of doubles in unlike orders gave them a spread of about 1e-12 and a z of 1e13."""
    rows = spark.range(6000).selectExpr("id", "CAST(id AS DOUBLE) AS pred", "round(100000 * pmod(id * 7919, 9973) / 9973 + 0.1, 4) AS err",
                                        "CAST(id AS DOUBLE) AS spread", "5L AS n_lines").repartition(13)
    monkeypatch.setattr(q_refits, "calib_rows", lambda spark, sf: rows)
    monkeypatch.setattr(q_refits, "test_rows", lambda spark, sf: rows)
    heads = [{"kind": "band", "placebo": i, "ma": 0.0, "mb": 0.0, "my": 0.0, "wa": 1.0 + i / 7, "wb": 0.0} for i in range(21)]
    monkeypatch.setattr(q_refits, "stage", lambda df, name: spark.createDataFrame(heads))
    got = q_refits.placebo_test(spark, "").first()
    assert (got["sd"], got["z"], got["p"]) == (0.0, None, 1.0)
