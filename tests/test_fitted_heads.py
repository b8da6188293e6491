"""Fitted heads score rows in a session that has observed a metric, as their model's own transform does in one that hasn't."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from evalmill.operators import score


@pytest.fixture()
def observed(spark):
    noted = Observation()
    spark.range(3).observe(noted, F.count(F.lit(1)).alias("n")).collect()
    assert noted.get["n"] == 3
    return spark


def test_linear_heads(observed):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 4))
    rows = observed.createDataFrame([(i, [float(v) for v in x[i]], int(x[i, 0] - x[i, 1] + rng.normal() > 0)) for i in range(200)], "id long, v array<double>, label int")
    for non_negative in (False, True):
        model = score.linear_head(rows, "v", non_negative=non_negative)
        got = {r["id"]: r["score"] for r in score.head_scores(model, rows, "v", "id").collect()}
        odds = x @ model.coefficients.toArray() + model.intercept
        assert [got[i] for i in range(200)] == pytest.approx(list(1 / (1 + np.exp(-odds))), abs=1e-12)
        plain = model.predictProbability(rows.select(array_to_vector("v").alias("x")).first()["x"])[1]
        assert got[rows.first()["id"]] == pytest.approx(plain, abs=1e-12)


def test_shortcut_probe(observed):
    rows = observed.createDataFrame([(i, i % 2, float(i % 7) if i % 5 else None, "ab"[i % 2] if i % 3 else "c") for i in range(90)], "id long, label int, size double, kind string")
    found = score.shortcut_probe(rows.filter("id % 4 < 2"), rows.filter("id % 4 >= 2"), ["size"], ["kind"], "id").collect()
    assert len(found) == 44 and all(0 <= r["score"] <= 1 for r in found)
    told = [r for r in found if r["id"] % 3]
    assert min(r["score"] for r in told if r["label"]) > max(r["score"] for r in told if not r["label"])
