"""The stratified bootstrap draws as many rows of each label as there are, in every replicate."""

import hashlib

import numpy as np
import pytest

from evalmill.operators import replicates


def test_draws(spark, monkeypatch):
    monkeypatch.setattr(replicates, "DRAWS", 70)
    monkeypatch.setattr(replicates, "PLACES", 64)
    labels = {i: int(i % 3 == 0) for i in range(300)}
    rows = spark.createDataFrame([(i, y, i / 300) for i, y in labels.items()], "id long, label int, s double").repartition(5)
    got = {r["id"]: np.frombuffer(r["times"], dtype=np.uint8) for r in replicates.drawn_rows(rows, "id", ["s"], 20, 11).collect()}
    for y in (0, 1):
        ids = [i for i in range(300) if labels[i] == y]
        want = np.zeros((len(ids), 20), dtype=int)
        for r in range(20):
            for draw in range(1, len(ids) + 1):
                want[int(hashlib.sha256(f"11:{r}:{y}:{draw}".encode()).hexdigest()[:12], 16) % len(ids), r] += 1
        assert (want.sum(axis=0) == len(ids)).all() and (np.stack([got[i] for i in ids]) == want).all()


def test_no_rows_and_one_label(spark):
    none = spark.createDataFrame([], "id long, label int, a double, b double")
    assert replicates.stratified_bootstrap_auc(none, "id", "a", "b", 10, 1).count() == 0
    one = spark.createDataFrame([(1, 1, 0.5, 0.5)], "id long, label int, a double, b double")
    assert replicates.stratified_bootstrap_auc(one, "id", "a", "b", 10, 1).filter("median IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="isn't finite"):
        replicates.stratified_bootstrap_auc(one.selectExpr("id", "label", "double(null) AS a", "b"), "id", "a", "b", 10, 1).collect()
