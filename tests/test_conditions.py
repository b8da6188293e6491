"""Condition kernels on small pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import conditions
from evalmill.plans.bindings import CONDITIONS


def test_kernels_on_colours():
    rng = np.random.default_rng(1)
    x = rng.random((3, 10, 5, 3))
    run = lambda name, y=x: conditions.kernel(name)(y, ["a", "b", "c"], CONDITIONS.index(name), 7)
    grey = x @ [0.299, 0.587, 0.114]
    assert np.allclose(run("saturation_0.8"), grey[..., None] + (x - grey[..., None]) * 0.8)
    assert np.allclose(run("contrast_1.2"), np.clip(grey.mean(axis=(1, 2))[:, None, None, None] * -0.2 + x * 1.2, 0, 1))
    assert np.allclose(run("brightness_1.2"), np.minimum(1, x * 1.2)) and np.array_equal(run("clean"), x)
    assert run("center_crop_80").shape == (3, 8, 4, 3) and np.array_equal(run("center_crop_80"), x[:, 1:9, 0:4])
    flat = np.full((3, 9, 9, 3), 0.3)
    for name in CONDITIONS:
        if name.startswith(("blur", "resize", "contrast", "saturation", "center")):
            assert np.allclose(run(name, flat), 0.3)
    noisy = run("noise_sigma_0.10", np.full((3, 40, 40, 3), 0.5))
    assert abs((noisy - 0.5).std() - 0.1) < 0.003 and abs(noisy.mean() - 0.5) < 0.003
    assert not np.array_equal(noisy[0], noisy[1]) and not np.allclose(conditions.normals(["a"], 10, 48, 7), conditions.normals(["a"], 11, 48, 7))
    with pytest.raises(ValueError, match="jpeg_q90"):
        conditions.kernel("jpeg_q90")


def test_bicubic_weights():
    for to, length in ((4, 8), (8, 4), (2, 8), (8, 2), (5, 5), (1, 7)):
        w = conditions.bicubic_weights(to, length)
        assert w.shape == (to, length) and np.allclose(w.sum(axis=1), 1) and np.allclose(w, w[::-1, ::-1])
    assert np.allclose(conditions.bicubic_weights(5, 5), np.eye(5))


def test_one_pass_and_odd_pictures(spark):
    rows = [(2**53 + 1, [0.25] * 12), (None, [0.5] * 12), (3, None), (4, [0.5] * 11), (5, [float(i) / 12 for i in range(12)])]
    table = spark.createDataFrame(rows, "id long, p array<double>").repartition(3)
    made = conditions.each_condition(table, "id", "p", (2, 2, 3), CONDITIONS, ["clean", "noise_sigma_0.05", "center_crop_80"], 7)
    got = {(r["id"], r["condition"]): r["pixels"] for r in made.collect()}
    assert {i for i, _ in got} == {2**53 + 1, None, 5} and len(got) == 9
    assert got[(5, "clean")] == rows[4][1] and len(got[(5, "center_crop_80")]) == 12
    assert made.filter("idx <> 0 AND condition = 'clean'").count() == 0
    scored = conditions.each_condition(table, "id", "p", (2, 2, 3), CONDITIONS, ["clean"], 7, conditions.linear_score(np.ones((2, 2)), 1.0))
    assert scored.filter(F.col("id") == 2**53 + 1).first()["score"] == pytest.approx(1 / (1 + np.exp(-1)))
    assert conditions.each_condition(table.limit(0), "id", "p", (2, 2, 3), CONDITIONS, ["clean"], 7).count() == 0
