from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import whitening as wh


def brute(vectors):
    """(n, x, sums, eigenvalues, unit vectors as columns) by exact sums and numpy's eigenvectors."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    v = np.array([[float(sum(Fraction(n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3) for j in range(len(sums))] for i in range(len(sums))])
    values, units = np.linalg.eigh(v)
    return n, x, sums, values[::-1], units[:, ::-1], v.trace()


def check(rows, key_to_vector, components=8):
    n, x, sums, values, units, trace = brute([v for _, v in key_to_vector])
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    want = {}
    for (key, _), row in zip(key_to_vector, x):
        want.setdefault(key, []).append((sum((n * c - s) ** 2 for c, s in zip(row, sums)), [float(Fraction(n * c - s, n)) for c, s in zip(row, sums)]))
    assert len(rows) == k * len(x)
    sign = {}
    for r in rows:
        assert r["n"] == n and r["deviation"] in {d for d, _ in want[r["vec_id"]]} and 0 <= r["identity_error"] < 1e-6
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
        assert any(abs(abs(np.dot(far, units[:, c]) / values[c] ** 0.5) - abs(r["whitened"])) < 1e-6 for d, far in want[r["vec_id"]] if d == r["deviation"])
        if len(want[r["vec_id"]]) == 1 and abs(r["whitened"]) > 1e-3:
            sign.setdefault(c, set()).add(np.sign(np.dot(want[r["vec_id"]][0][1], units[:, c])) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in sign.values())


def test_small_tables_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, d in ((40, 5), (3, 6), (200, 12)):
        data = [(i, [float(c) for c in rng.normal(0, 1 + np.arange(d), d)]) for i in range(n)]
        table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
        check(wh.whiten(table, "vec_id", "embedding").collect(), data)


def test_query_does_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = wh.op13_embedding_whitening(spark, sf_dir)
    assert rows.count() == 8 * table.count()
    of = lambda df: {(r["vec_id"], r["component"]): (r["n"], r["deviation"], round(r["whitened"], 8), round(r["explained"], 12)) for r in df.collect()}
    assert of(rows) == of(wh.whiten(table.repartition(7), "vec_id", "embedding"))
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-9
    moments = rows.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v"), F.first("explained").alias("e")).orderBy("component").collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-9 for r in moments)
    shares = [r["e"] for r in moments]
    assert shares == sorted(shares, reverse=True)
    x = wh.whole_numbers(table.select("embedding").toPandas()["embedding"])
    values = np.linalg.eigvalsh(np.cov(x.T.astype(float), bias=True))[::-1]
    assert shares == pytest.approx((values / values.sum())[:8], rel=1e-9)


def test_cases(spark):
    nan, inf, big = float("nan"), float("inf"), 2**53 + 1
    good = [(big, [1.0, 2.0]), (None, [0.5, -1.0]), (big + 2, [1.0, 2.0]), (4, [-3.25, 0.0]), (4, [-3.25, 0.0]), (5, [0.0, 0.001])]
    bad = [(6, None), (7, []), (8, [1.0, None]), (9, [nan, 1.0]), (10, [1.0, -inf]), (11, [1.0, 2.0, 3.0]), (12, [2.0**41, 0.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<double>, component int, id string").repartition(4)
    rows = wh.whiten(table, "vec_id", "embedding").collect()
    check(rows, good)
    assert {r["vec_id"] for r in rows} == {r[0] for r in good}
    assert wh.whiten(table.limit(0), "vec_id", "embedding").count() == 0
    one = spark.createDataFrame(good[:1] * 3, "vec_id long, embedding array<double>")
    assert wh.whiten(one, "vec_id", "embedding").count() == 0  # no variance, no component
    assert wh.whiten(one, "vec_id", "embedding").columns == wh.whiten(table, "vec_id", "embedding").columns


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(c) for c in rng.uniform(-1, 1, 3) * 2.0**39]) for i in range(50)]
    rows = wh.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    n, x, sums, values, units, trace = brute([v for _, v in data])
    want = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}
    assert all(r["deviation"] is None and r["distance2"] == pytest.approx(want[r["vec_id"]] / n**2) for r in rows)  # beyond 64 bits
    assert sorted({r["explained"] for r in rows}, reverse=True) == pytest.approx(list(values / trace), rel=1e-9)
    y = rng.integers(-(2**50), 2**50, (20_000, 2))
    assert wh.products(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(2)] for i in range(2)]
    assert wh.exact_sum(y + 2**52).tolist() == [sum(int(a) + 2**52 for a in y[:, i]) for i in range(2)]


def test_factor_and_rotations():
    rng = np.random.default_rng(7)
    for d, rank in ((9, 9), (16, 5), (33, 33), (1, 1), (4, 0)):
        a = rng.normal(0, 1, (d, rank)) * 10.0 ** -np.arange(rank).clip(0, 6)
        v = a @ a.T
        g = wh.pivoted_cholesky(v)
        assert np.allclose(g @ g.T, v, atol=1e-12) and g.shape[1] <= d
        values, units = wh.one_sided_jacobi(g)
        assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-10)
        assert np.allclose(units * values @ units.T, v, atol=1e-12)
