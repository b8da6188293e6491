"""What a checkpoint leaves on the disk."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from evalmill.operators.order import CLEAN_UP, cut_lineage


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_UP)
    rows = spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    made = cut_lineage(rows)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEAN_UP) == setting
    assert made.select(F.sum(F.size("ids")), F.count("k")).first()[:] == (20_000, 100)
    assert rows.count() == 100  # the frame itself can be run again
