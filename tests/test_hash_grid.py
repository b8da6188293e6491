"""Near hashes by bands and by the grid are the same pairs; wide radii don't become thousands of literals."""

import numpy as np
import pytest

from evalmill.operators import neighbours


def tables(spark, n_left, n_right, seed):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(-(2**63), 2**63, n, dtype=np.int64) for n in (n_left, n_right))
    y[: n_left // 2] = x[: n_left // 2] ^ (1 << rng.integers(0, 62, n_left // 2))
    y[-5:] = x[-5:]
    frame = lambda h: spark.createDataFrame(list(enumerate(h.tolist())) + [(len(h), None), (len(h) + 1, int(h[0]))], "k long, h long")
    return np.append(x, x[0]), np.append(y, y[0]), frame(x), frame(y)


@pytest.mark.parametrize(("radius", "side"), [(2, 32_768), (18, 50)])
def test_bands_and_grid(spark, monkeypatch, radius, side):
    x, y, left, right = tables(spark, 150, 400, radius)
    far = np.bitwise_count((x[:, None] ^ y[None]).view(np.uint64))
    at = lambda i, n: int(i) + (i == n - 1)  # noqa: E731  the last row's key comes after the null's
    want = sorted((at(i, len(x)), at(j, len(y)), int(far[i, j])) for i, j in zip(*np.nonzero(far <= radius)))
    nearest = {}
    for i, j, d in want:
        nearest[i] = min(nearest.get(i, (99, 0)), (d, j))
    monkeypatch.setattr(neighbours, "SIDE", side)
    for pays in (True, False):
        if radius < 5 or not pays:
            monkeypatch.setattr(neighbours, "banding_pays", lambda *_, pays=pays: pays)
            assert sorted(map(tuple, neighbours.hamming_pairs(left, right, "k", "h", radius).collect())) == want
            assert {r["a"]: (r["distance"], r["b"]) for r in neighbours.nearest_hash(left, right, "k", "h", radius).collect()} == nearest


def test_plans_stay_small(spark, capsys):
    rows = spark.range(60_000).selectExpr("id AS k", "xxhash64(id) AS h")
    for found in (neighbours.hamming_pairs(rows, rows, "k", "h", 16, 63), neighbours.nearest_hash(rows, rows, "k", "h", 20, 63)):
        found.explain("extended")
        assert len(capsys.readouterr().out) < 100_000
    assert neighbours.banding_pays(63, 4, 1_000_000) and not neighbours.banding_pays(63, 16, 1_000_000)
