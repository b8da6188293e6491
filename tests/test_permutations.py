"""Permutation replicates held by tasks and shuffled ones give the same; the first kind shuffles no row for each replicate."""

import pytest
from pyspark.sql import functions as F

from evalmill.operators import stats


def test_both_ways(spark, monkeypatch):
    rows = spark.range(137).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("g"), (F.col("id") * 7919 % 101).cast("double").alias("v")).repartition(5)
    monkeypatch.setattr(stats, "BATCH", 30)
    packed = stats.permutation_test(rows, "id", "g", "v", 100, 7).collect()
    sums = stats.permuted_sums(rows, "id", "g", "v", 100, 7)
    assert sums.agg(F.count_distinct("replicate"), F.sum("n"), F.sum("s")).first() == (100, 13_700, pytest.approx(100 * rows.agg(F.sum("v")).first()[0]))
    monkeypatch.setattr(stats, "PACKED", 100)
    assert packed == stats.permutation_test(rows, "id", "g", "v", 100, 7).collect()


def test_no_row_is_shuffled_for_each_replicate(spark, capsys):
    rows = spark.range(50).selectExpr("id", "cast(id % 3 AS string) AS g", "cast(id AS double) AS v")
    stats.permutation_test(rows, "id", "g", "v", 1000, 7).explain()
    assert "999)" not in (plan := capsys.readouterr().out) and "sequence(0, 999" not in plan and "Window" not in plan.split("FlatMapGroupsInPandas")[0]
