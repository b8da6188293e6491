"""Training by epochs against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import training


def table(spark, n=400, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d))
    y = (x @ np.array([2.0, -1.0, 0.5, 0, 0, 1.0]) + rng.normal(0, 0.5, n) > 0).astype(int)
    w = rng.random(n) + 0.1
    return x, y, w, spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), float(w[i])) for i in range(n)], "id long, v array<double>, label int, weight double")


@pytest.mark.parametrize("clamp", [False, True])
def test_full_batches_against_numpy(spark, clamp):
    x, y, w, rows = table(spark)
    theta, want = np.zeros(7), []
    for _ in range(6):
        odds = x @ theta[:-1] + theta[-1]
        want.append(float((w * (np.logaddexp(0, odds) - y * odds)).sum() / w.sum()))
        e = w * (1 / (1 + np.exp(-odds)) - y)
        theta -= 0.7 * np.append(e @ x, e.sum()) / w.sum()
        if clamp:
            theta[:-1] = np.maximum(0, theta[:-1])
    for parts in (2, 5):
        head = training.train_head(rows.repartition(parts), "id", "v", "label", "weight", epochs=6, rate=0.7, non_negative=clamp)
        assert head.losses == pytest.approx(want, abs=1e-12) and head.weights == pytest.approx(theta[:-1], abs=1e-12)
    assert head.losses == sorted(head.losses, reverse=True) and (not clamp or (head.weights >= 0).all())


def test_steps_and_moments_learn(spark):
    x, y, _, rows = table(spark)
    head = training.train_head(rows, "id", "v", "label", epochs=6, steps=3, rate=0.3, decay=0.001, adaptive=True)
    assert np.mean((head.odds(x) > 0) == (y == 1)) > 0.93 and head.losses[-1] < 0.5 * head.losses[0]
    again = training.train_head(rows.repartition(7), "id", "v", "label", epochs=6, steps=3, rate=0.3, decay=0.001, adaptive=True)
    assert again.weights == pytest.approx(head.weights, abs=1e-12)


def test_rows_that_cannot_be_learned_from(spark):
    _, _, _, rows = table(spark, 50)
    odd = spark.createDataFrame([(900, None, 1, 1.0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1.0), (902, [float("nan")] * 6, 0, 1.0), (903, [0.0] * 6, None, 1.0), (904, [9.0] * 6, 1, None)], rows.schema)
    want = training.train_head(rows, "id", "v", "label", "weight", epochs=2).losses
    assert training.train_head(rows.unionByName(odd), "id", "v", "label", "weight", epochs=2).losses == pytest.approx(want)
    with pytest.raises(ValueError, match="no rows"):
        training.train_head(rows.limit(0), "id", "v", "label")
    with pytest.raises(ValueError, match="entries"):
        training.train_head(rows.withColumn("v", F.when(F.col("id") == 1, F.array(F.lit(1.0))).otherwise(F.col("v"))), "id", "v", "label")
