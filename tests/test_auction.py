"""The auction against all assignments of small inputs, and its certificate on larger ones."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalmill.operators import auction

SCHEMA = "id long, v array<double>"


def cosines(left, right):
    unit = lambda m: np.array(m) / np.maximum(1e-300, np.linalg.norm(m, axis=1, keepdims=True))
    return unit(left) @ unit(right).T


def best_total(s):
    return max(sum(s[i, j] for i, j in enumerate(p)) for p in permutations(range(s.shape[1]), s.shape[0])) if s.shape[0] <= s.shape[1] else best_total(s.T)


def made(spark, left, right, **options):
    tables = [spark.createDataFrame([(base + i, [float(c) for c in v]) for i, v in enumerate(m)], SCHEMA).repartition(3) for base, m in ((0, left), (100, right))]
    return auction.Assignment(*tables, "id", "v", **options)


def test_optimum_of_small_inputs(spark):
    rng = np.random.default_rng(4)
    for n, m in ((6, 6), (7, 4)):
        left, right = rng.normal(0, 1, (n, 3)), rng.normal(0, 1, (m, 3))
        got = made(spark, left, right, epsilon=1e-5)
        pairs, proof = got.pairs().collect(), got.certificate().first()
        assert len(pairs) == min(n, m) == len({r["a"] for r in pairs}) == len({r["b"] for r in pairs})
        s = cosines(left, right)
        assert all(r["similarity"] == pytest.approx(s[r["a"], r["b"] - 100], abs=1e-8) for r in pairs)
        assert proof["total"] == pytest.approx(best_total(s), abs=1e-4)
        assert proof["total"] - 1e-9 <= proof["bound"] <= proof["total"] + proof["n"] * 1e-5 + 1e-9


def test_copies_and_slots(spark):
    right = [[1, 0], [0.9, 0.1], [0.5, 0.5], [0, 1], [0.1, 0.9], [0.2, 0.7]]
    got = made(spark, [[1.0, 0.0], [0.0, 1.0]], right, capacity=3, epsilon=1e-4).pairs()
    assert {(r["a"], r["b"]) for r in got.collect()} == {(0, 100), (0, 101), (0, 102), (1, 103), (1, 104), (1, 105)}
    left = [[1.0, 0.0]] * 5 + [[0.0, 1.0]]
    copies = made(spark, left, right, epsilon=1e-4)
    s = cosines(left, right)
    assert copies.certificate().first()["total"] == pytest.approx(best_total(s), abs=1e-3)
    assert copies.bidders.count() == 2 and copies.pairs().select("a").distinct().count() == 6


def test_blocks_and_short_lists_keep_the_bound(spark):
    rng = np.random.default_rng(6)
    left, right = rng.normal(0, 1, (60, 6)), rng.normal(0, 1, (90, 6))
    got = made(spark, left, right, epsilon=0.05, block=40, listed=8)
    proof = got.certificate().first()
    assert got.pairs().agg(F.count_distinct("a"), F.count_distinct("b")).first()[:] == (60, 60)
    assert proof["rounds"] > 1 and proof["total"] <= proof["bound"] <= proof["total"] + 3 + 1e-6


def test_rows_without_vectors_and_empty_sides(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0])]
    left = spark.createDataFrame(rows, SCHEMA)
    right = spark.createDataFrame([(2**53 + 1, [1.0, 0.1]), (2**53 + 3, [0.0, 1.0])], SCHEMA)
    got = auction.Assignment(left, right, "id", "v").pairs().collect()
    assert {r["a"] for r in got} == {1, 4} and {r["b"] for r in got} == {2**53 + 1, 2**53 + 3}
    none = auction.Assignment(left.limit(0), right, "id", "v")
    assert none.pairs().count() == 0 and none.certificate().first()["bound"] == 0


def test_a_block_keeps_what_the_rule_promises():
    rng = np.random.default_rng(8)
    n, m = 30, 40
    s = rng.random((n, m))
    lists = pd.DataFrame({"a": np.repeat(np.arange(n), m), "b": np.tile(np.arange(m), n), "similarity": s.ravel(), "price": 0.0, "mine": False})
    out = auction.block_auction(pd.DataFrame({"a": np.arange(n), "room": 1, "bound": -np.inf}), lists, 0.02)
    sold = out[out["b"] >= 0]
    price = np.zeros(m)
    price[sold["b"]] = sold["price"]
    assert sorted(sold["a"]) == list(range(n))
    for a, b in zip(sold["a"], sold["b"]):
        assert s[a, b] - price[b] >= (s[a] - price).max() - 0.02 - 1e-12
