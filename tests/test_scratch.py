"""Shuffle files of a step go before the next one writes its own."""

import time
from pathlib import Path

from pyspark.sql import functions as F


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data")}


def test_files_of_the_last_step_go(spark):
    from wakeline.scratch import Scratch

    scratch = Scratch(spark, "freed")
    before = shuffle_files(spark)
    saved = scratch.save(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    assert shuffle_files(spark) - before
    scratch.free()
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and saved.count() == 1000
