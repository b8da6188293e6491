"""Bootstrap replicates and quantiles against numpy, on ties and on any partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import replicates, stats


def auc_of(scores, labels, times):
    pos, neg = labels == 1, labels == 0
    wins = (scores[pos][:, None] > scores[neg][None]) + 0.5 * (scores[pos][:, None] == scores[neg][None])
    return float(times[pos] @ wins @ times[neg] / (times[pos].sum() * times[neg].sum()))


@pytest.mark.parametrize("levels", [1000, 7, 1])
def test_against_numpy(spark, levels):
    rng = np.random.default_rng(levels)
    n, r = 300, 40
    labels = rng.integers(0, 2, n)
    a, b = (np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.3), 0, 1) * levels) / levels for _ in range(2))
    rows = spark.createDataFrame([(i, int(y), float(s), float(t)) for i, (y, s, t) in enumerate(zip(labels, a, b))], "id long, label int, a double, b double").repartition(5)
    times = replicates.counters([str(i) for i in range(n)], 3, r)
    assert 0.9 < times.mean() < 1.1 and 0.8 < times.var() < 1.2
    want = {k: [auc_of(s, labels, times[:, j]) for j in range(r)] for k, s in (("auc_a", a), ("auc_b", b))}
    want["delta"] = [y - x for x, y in zip(want["auc_a"], want["auc_b"])]
    for parts in ("4", "9"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x["metric"]: x for x in replicates.bootstrap_auc(rows, "id", "a", "b", r, 3).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for metric, values in want.items():
            assert [got[metric][q] for q in ("q025", "median", "q975")] == pytest.approx(list(np.quantile(values, [0.025, 0.5, 0.975])), abs=1e-8)


def test_no_rows_and_one_label(spark):
    none = spark.createDataFrame([], "id long, label int, a double, b double")
    assert replicates.bootstrap_auc(none, "id", "a", "b", 10, 1).count() == 0
    one = spark.createDataFrame([(1, 1, 0.5, 0.5)], "id long, label int, a double, b double")
    assert replicates.bootstrap_auc(one, "id", "a", "b", 10, 1).filter("median IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="isn't finite"):
        replicates.bootstrap_auc(one.withColumn("a", F.lit(None).cast("double")), "id", "a", "b", 10, 1).collect()


def test_quantiles_of_frequent_values(spark):
    rng = np.random.default_rng(9)
    values = {"a": np.append(np.full(400, 3.0), rng.normal(0, 5, 500)), None: rng.integers(0, 4, 77).astype(float), "one": np.array([2.5]), "same": np.full(50, 7.0)}
    table = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("empty", None), ("a", None)], "k string, v double").repartition(6)
    points = {"q05": 0.05, "median": 0.5, "q95": 0.95, "low": 0.0, "high": 1.0}
    for parts in ("3", "11"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["__k0"]: [r[n] for n in points] for r in stats.cell_quantiles(table, ["k"], "v", points).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert set(got) == set(values)
        for k, vs in values.items():
            assert got[k] == pytest.approx(list(np.quantile(vs, list(points.values()))))
    whole = {r["k"]: r for r in stats.distribution(table, ["k"], "v").collect()}
    assert whole["empty"]["n"] == 0 and whole["empty"]["median"] is None and whole["same"]["q05"] == 7.0
