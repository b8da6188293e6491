"""Permutations of a table of 6 GB stay in tasks; beyond that, replicates are shuffled in waves that leave nothing."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from evalmill.operators import stats
from evalmill.operators.order import shared_folder


def table(spark, n=137):
    group = F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 4).cast("string")))
    value = F.when(F.col("id") % 9 > 0, (F.col("id") * 7919 % 101).cast("double"))
    return spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), group.alias("g"), value.alias("v")).repartition(5)


def test_gaps_shuffle_no_row_for_each_replicate(spark, capsys):
    stats.permutation_test(table(spark), "id", "g", "v", 1000, 7).explain()
    assert "sequence(0, 999" not in capsys.readouterr().out


def test_waves_equal_tasks_and_leave_nothing(spark, monkeypatch):
    rows = table(spark)
    packed = stats.permutation_test(rows, "id", "g", "v", 50, 7).collect()
    folder = shared_folder(spark).removeprefix("file:")
    monkeypatch.setattr(stats, "PACKED", 100)
    monkeypatch.setattr(stats, "WAVE", 1500)
    before = set(os.listdir(folder))
    ranges = []
    sequence = F.sequence
    monkeypatch.setattr(F, "sequence", lambda a, b: ranges.append((a, b)) or sequence(a, b))
    assert packed == stats.permutation_test(rows, "id", "g", "v", 50, 7).collect()
    assert len(ranges) == 5  # ten replicates of 137 rows are a wave
    assert len(set(os.listdir(folder)) - before) <= 1  # the order by range


def test_replicates_against_their_definition(spark, monkeypatch):
    monkeypatch.setattr(stats, "BATCH", 3)
    monkeypatch.setattr(stats, "HASHED", 20)
    rows = [(i, i % 3, float(i * i % 17)) for i in range(50)]
    made = stats.permuted_sums(spark.createDataFrame(rows, "id long, g int, v double").repartition(4), "id", "g", "v", 7, 5)
    got = {(r["replicate"], r["group"]): (r["n"], r["s"], r["q"]) for r in made.collect()}
    by_key = sorted(rows)
    for replicate in range(7):
        dealt = sorted(rows, key=lambda r: hashlib.sha256(f"5:{replicate}:{r[0]}".encode()).hexdigest())
        for g in range(3):
            v = [x[2] for x, label in zip(dealt, by_key) if label[1] == g]
            assert got[replicate, g] == (len(v), pytest.approx(sum(v)), pytest.approx(sum(x * x for x in v)))


def test_order_of_equal_hashes():
    keys = [b":b", b":a", b":b", b"", b":a", b""]
    digests = [hashlib.sha256(b"1:2" + k).digest() for k in keys]
    assert stats.hash_order(keys, b"1:2").tolist() == sorted(range(6), key=lambda i: (digests[i], i))


def test_a_table_of_6_gb_is_held():
    assert 12 * 91_816 <= stats.PACKED
