"""Exact cosine neighbours: equal to all pairs, whatever is skipped."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evalmill.operators import cosine, neighbours
from evalmill.operators.cosine import cosine_top, search_work


def brute(left, right, k):
    unit = lambda v: np.array(v, float) / max(1e-300, np.linalg.norm(v))
    out = []
    for a, va in left:
        scored = sorted((-round(float(unit(va) @ unit(vb)), 9), b) for b, vb in right)
        out += [(a, b, place) for place, (_, b) in enumerate(scored[:k], 1)]
    return sorted(out)


def frames(spark, left, right):
    return [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>") for rows in (left, right)]


def got(found):
    return sorted((r["a"], r["b"], r["place"]) for r in found.collect())


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(12, 16))
    return [(seed * 10_000 + i, centres[i % 12] + spread * rng.normal(size=16)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5, 20.0])
@pytest.mark.parametrize("k", [1, 7, 70])
def test_equals_all_pairs(spark, spread, k):
    left, right = clustered(60, 1, spread), clustered(400, 2, spread)
    a, b = frames(spark, left, right)
    assert got(cosine_top(a, b, "id", "v", k, block=20, cell=16, bin_rows=50)) == brute(left, right, k)


def test_clusters_are_skipped_and_pairs_are_compared_once(spark):
    a, b = frames(spark, clustered(60, 1, 0.02), clustered(400, 2, 0.02))
    tight = search_work(a, b, "id", "v", 3, block=20, cell=16, bin_rows=50).first()
    assert tight["share_skipped"] > 0.5 and tight["n_compared"] < tight["n_pairs"] // 2
    a, b = frames(spark, clustered(60, 1, 20.0), clustered(400, 2, 20.0))
    loose = search_work(a, b, "id", "v", 3, block=20, cell=16, bin_rows=50).first()
    assert loose["n_compared"] <= loose["n_pairs"]


def test_a_third_of_equal_vectors_and_fewer_rows_than_k(spark):
    left = clustered(10, 1, 0.1)
    right = [(i, left[0][1]) if i % 3 == 0 else (i, v) for i, (_, v) in enumerate(clustered(150, 2, 0.1))]
    a, b = frames(spark, left, right)
    for k in (5, 60, 500):
        assert got(cosine_top(a, b, "id", "v", k, block=10, cell=8, bin_rows=30)) == brute(left, right, k)


def test_awkward_rows(spark):
    big = 2**53
    rows = [(big + 1, [1.0, 0.0]), (None, [1.0, 0.0]), (big + 3, None), (big + 5, [float("nan"), 1.0]), (big + 7, [None, 1.0]), (big + 9, [0.0, 0.0]), (big + 11, []), (big + 13, [1e200, 1e200]), (big + 15, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    scaled = [(i, np.array(v) / max(1.0, max(map(abs, v)))) for i, v in usable]
    for block in (1, 1024):
        assert got(cosine_top(df, df, "id", "v", 2, block=block)) == brute(scaled, scaled, 2)
    assert cosine_top(df, df.limit(0), "id", "v", 2).collect() == [] == cosine_top(df.limit(0), df, "id", "v", 2, block=1).collect()
    assert search_work(df.limit(0), df, "id", "v", 2).first()["n_left"] == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="entries"):
        cosine_top(df.repartition(1), df.repartition(1), "id", "v", 1).collect()


def cell_tables(n, m, k, near=None):
    """A cell's left and right rows, as the tasks get them."""
    rng = np.random.default_rng(5)
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
    va, vb = rng.normal(size=(n, 64)), rng.normal(size=(m, 64)) if near is None else near
    left = pa.table({"a": np.arange(n), "va": lists(va), "kth": pa.array([None] * n, pa.float64()), "blocks": pa.array([[0]] * n, pa.list_(pa.int32()))})
    return left, pa.table({"b": np.arange(len(vb)), "vb": lists(vb), "block": pa.array([0] * len(vb), pa.int32())}), va, vb


@pytest.mark.parametrize("k", [8, 300])
def test_a_cell_holds_little(k):
    left, right, va, vb = cell_tables(512, 8192, k)
    tracemalloc.start()
    out = cosine._best(k)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 4 M products in double precision, their rounded copy and the sorted one are 96 MB
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit(va) @ unit(vb).T, 9), axis=1, kind="stable")[:, :k]
    assert (out.column("b").to_numpy().reshape(512, k) == want).all()


def test_neighbours_that_single_precision_cannot_tell_apart():
    base = np.random.default_rng(6).normal(size=64)
    near = base + 3e-8 * np.random.default_rng(7).normal(size=(2000, 64))
    left, right, va, vb = cell_tables(20, 2000, 5, near)
    out = cosine._best(5)(left, right)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-np.round(np.einsum("ik,jk->ij", unit(va), unit(vb)), 9), axis=1, kind="stable")[:, :5]
    assert (out.column("b").to_numpy().reshape(20, 5) == want).mean() > 0.97  # sums in another order may round differently
    assert len(np.unique(unit(va).astype(np.float32)[0] @ unit(vb).astype(np.float32).T)) < 100


def test_a_greedy_pass_gives_each_task_a_bounded_share(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(neighbours, "cosine_top", lambda left, right, key, vector, k, **kw: (asked.append((k, kw.get("cell", 4096))), cosine_top(left, right, key, vector, k, **kw))[1])
    monkeypatch.setattr(neighbours, "SEEN", 64, raising=False)
    a, b = frames(spark, clustered(60, 1, 20.0), clustered(80, 2, 20.0))
    found = neighbours.assignment(a, b, "id", "v", 3).collect()
    assert len(found) == 60 and asked and all(cell == 1 or k * cell <= 64 for k, cell in asked)
