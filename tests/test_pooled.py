"""Disk and counts of the pooled evaluation."""

from pathlib import Path

from demur.plans import QUERIES, q_crossfit
from demur.sources.staging import CLEANUP_SETTING, shared_folder


def shuffled(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data"))


def ordered(spark):
    return sum(f.stat().st_size for f in Path(shared_folder(spark)).glob("runs-*/*.loss"))


def test_shuffles_of_pooled_curves_are_removed(spark, sf):
    """All repeats and gates were sorted at once, and their shuffle files stayed until the driver collected its garbage: more bytes than the losses they order."""
    q_crossfit.x_rows(spark, sf).count()
    before, files, setting = shuffled(spark), ordered(spark), spark.conf.get(CLEANUP_SETTING)
    got = QUERIES["pooled_eval"](spark, sf)
    assert ordered(spark) > files and shuffled(spark) - before < (ordered(spark) - files) / 4
    assert spark.conf.get(CLEANUP_SETTING) == setting and got.count() == 120


def test_pooled_evaluation_draws_the_published_resamples(spark, sf):
    """With 10 resamples, and 5 for two band counts, no p was below 0.1."""
    got = QUERIES["pooled_eval"](spark, sf).filter("gate = 'perfect' AND coverage = 0.5").collect()
    assert {r["bands"]: r["p"] for r in got} == {0: 0.0005, 5: 0.001, 10: 0.0005, 20: 0.001}
