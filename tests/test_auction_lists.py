"""Lists are read in slices while objects stream by: what leaves a task is a row for each bidder, and a round's tables go once they are replaced."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import auction
from evalmill.operators.order import shared_folder


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vectors(spark, m, **columns):
    rows = [(i, [float(c) for c in v], *[c[i] for c in columns.values()]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, ", ".join(["id long", "v array<double>", *[f"{c} double" for c in columns]])).repartition(3)


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_lists_of_many_slices_equal_brute_force(spark, monkeypatch, kind):
    for name, value in (("SLICE", 16), ("FEW", 4), ("ROWS", 5), ("COLUMNS", 32)):
        monkeypatch.setattr(auction, name, value)
    rng = np.random.default_rng(3)
    va, vb, price, room = rng.normal(0, 1, (70, 5)).astype(np.float32), rng.normal(0, 1, (150, 5)).astype(np.float32), rng.random(150) * 3, rng.integers(1, 4, 70)
    vb[100:] = vb[50:100]  # equal vectors at other prices, and at equal ones
    price[100:120] = price[50:70]
    bidders = vectors(spark, va, n=room.astype(float).tolist()).select(F.col("id").alias("a"), F.col("v").cast(kind).alias("va"), F.col("n").cast("int").alias("room"), (F.col("n") + 6).cast("int").alias("take"))
    objects = vectors(spark, vb, price=price.tolist()).select(F.col("id").alias("b"), F.col("v").cast(kind).alias("vb"), "price")
    made = auction.priced_lists(bidders, objects)
    got = {r["a"]: r for r in made.collect()}
    s = np.round(unit(va.astype(float)) @ unit(vb.astype(float)).T, 9)
    assert sorted(got) == list(range(70))
    for a, r in got.items():
        gain = s[a] - price
        best = np.lexsort((np.arange(150), -gain))[: room[a] + 6]
        assert r["b"] == best.tolist() and r["room"] == room[a]
        assert np.abs(np.array(r["near"]) / auction.UNIT - s[a, best]).max() < 2e-9 and r["bound"] == pytest.approx(gain[best[-1]], abs=2e-9)


def test_a_list_of_all_objects_has_no_bound(spark):
    va, vb = np.eye(3), np.eye(3)[:2]
    bidders = vectors(spark, va).select(F.col("id").alias("a"), F.col("v").alias("va"), F.lit(1).alias("room"), F.lit(5).alias("take"))
    objects = vectors(spark, vb, price=[0.0, 0.0]).select(F.col("id").alias("b"), F.col("v").alias("vb"), "price")
    assert [(len(r["b"]), r["bound"]) for r in auction.priced_lists(bidders, objects).collect()] == [(2, float("-inf"))] * 3


def test_rounds_leave_no_tables(spark):
    rng = np.random.default_rng(6)
    left, right = (vectors(spark, rng.normal(0, 1, (n, 6))).withColumn("id", F.col("id") + n) for n in (60, 90))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    made = auction.Assignment(left, right, "id", "v", epsilon=0.05, block=40, listed=8)
    assert made.rounds > 1 and made.pairs().count() == 60
    # Two orders by range, rows, bidders, objects and the last state; every round left six tables before.
    assert len(set(os.listdir(folder)) - before) <= 6


def test_what_a_bidder_holds_is_on_its_list():
    price, holder, worth = np.array([0.5, 0.0, 0.0]), np.array([0, -1, 0]), np.array([0.9, 0.0, 0.4])
    market = auction._Market(np.array([2, 1]), np.array([0.1, 0.2]), np.array([0, 2, 3]), np.array([1, 2, 0]), np.array([0.3, 0.4, 0.8]), 1.0, price, holder, worth)
    assert market.first.tolist() == [0, 3, 4] and sorted(market.what[:3].tolist()) == [0, 1, 2] and market.near[2] == 0.9
    market.hold(0.01)
    assert holder.tolist() == [1, 0, 0] and price[0] > 0.5
