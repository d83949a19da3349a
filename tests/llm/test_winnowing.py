"""Winnowing: which fingerprints are kept, and hits by extension on either join, against every window compared."""

import random

import pytest
from pyspark.sql import functions as F

from demur.llm import decontam
from tests.llm.test_text import brute_hits


@pytest.mark.parametrize("prints", [None, 0])
def test_hits_equal_all_windows_compared(spark, prints):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(6)]  # few words: repeats, overlaps and many false meetings
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([3, 9, 10, 11, 14, 30])))) for i in range(25)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([0, 5, 10, 60])))) for i in range(40)]
    rows += [(100 + i, " ".join(items[i][1].split() + ["x"] + items[i + 1][1].split()[:-1])) for i in range(20)] + [(200, None), (201, items[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated(docs, bench, broadcast_prints=prints).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in rows)


def test_one_fingerprint_per_run_of_windows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = decontam.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").where("at >= 0").collect()
    places = [r["at"] for r in sorted(rows, key=lambda r: r["at"])]
    assert len(places) == len(set(places)) < 391 * 0.5  # far fewer than windows
    reach = decontam.WINDOW - decontam.GRAM
    assert places[0] <= reach and places[-1] >= 390 and all(b - a <= reach + 1 for a, b in zip(places, places[1:]))  # every window holds one


def test_one_window_of_many_items_is_counted_by_rows(spark):
    text = " ".join(f"w{i}" for i in range(10))
    bench = spark.range(3000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame([(1, f"a {text} b"), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, bench, broadcast_prints=2999).collect()}
    assert len(got[1]["items"]) == 3000 and got[1]["n_hit"] == 10 and not got[2]["contaminated"]
