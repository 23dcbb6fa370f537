"""What steps leave on the executors' disks."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from reelmill.llm import nearcopies
from reelmill.llm.common import written
from reelmill.session import FREED, checkpoint


def shuffled(spark):
    """The shuffle files there are now."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for d in dirs for p in Path(d).rglob("shuffle_*")}


def left(spark, before):
    """The shuffle files made since before, once those that are being removed are gone."""
    end = time.time() + 10
    while (more := shuffled(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return more


def test_a_kept_table_leaves_no_shuffle_files_and_may_be_made_again(spark):
    for keep in (checkpoint, written):
        df, before = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().repartition(3, "count"), shuffled(spark)
        kept = keep(df)
        assert not left(spark, before), keep.__name__
        rows = sorted(kept.collect())
        assert len(rows) == 700 and sorted(df.collect()) == rows and sorted(keep(df).collect()) == rows
        assert sorted(df.collect()) == rows


def test_a_kept_table_leaves_the_setting_as_it_was(spark):
    was = spark.conf.get(FREED, None)
    try:
        for value in ("false", "true"):
            spark.conf.set(FREED, value)
            checkpoint(spark.range(3))
            assert spark.conf.get(FREED) == value
        spark.conf.unset(FREED)
        checkpoint(spark.range(3))
        assert spark.conf.get(FREED, None) is None
    finally:
        if was is not None:
            spark.conf.set(FREED, was)


def test_near_copies_hold_no_shuffle_files_of_steps_that_are_done(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} and {i}") for i in range(20)] + [(100 + i, f"own {i} " * 9) for i in range(20)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shuffled(spark)
    made = nearcopies.near_copies(docs)
    assert len(left(spark, before)) == 0
    assert {r.component_id for r in made.collect() if r.doc_id < 100} == {0}
