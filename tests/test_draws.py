"""Draws with replacement: their number, their line, and rows without weight."""

import hashlib
from itertools import accumulate

from pyspark.sql import functions as F

from evalmill.operators import sample


def test_draws_against_the_line(spark):
    weights = [0.5, 0.0, 3.0, 1.25, 0.0, 2.0, 0.25, None, -1.0, 5.0]
    units = [round(max(0.0, w or 0.0) / 1e-12) for w in weights]
    ends = list(accumulate(units))
    want = [0] * len(weights)
    for i in range(500):
        place = int(hashlib.sha256(f"9:draw:{i}".encode()).hexdigest()[:12], 16) * ends[-1] >> 48
        want[next(k for k, e in enumerate(ends) if place < e)] += 1
    rows = spark.createDataFrame(list(enumerate(weights)), "id long, weight double")
    for parts in ("4", "9"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["times"] for r in sample.exact_draws(rows.repartition(3), "weight", 500, 9, "id").collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [got[i] for i in range(len(weights))] == want and sum(got.values()) == 500


def test_no_weight_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None)], "id long, weight double")
    assert {r["times"] for r in sample.exact_draws(rows, "weight", 10, 1, "id").collect()} == {0}
    assert sample.exact_draws(rows.limit(0), "weight", 10, 1, "id").count() == 0
    same = spark.createDataFrame([(1, 1.0)] * 5 + [(None, 5.0)], "id long, weight double")
    assert sample.exact_draws(same, "weight", 1000, 1, "id").agg(F.sum("times"), F.count("*")).first()[:] == (1000, 6)


def test_first_valid_of_a_group_in_many_ranges(spark):
    rows = [("hot", i, i % 3 != 0) for i in range(900)] + [(None, i, i % 2 == 1) for i in range(30)] + [("few", i, i == 1) for i in range(3)]
    want = set()
    for g in {r[0] for r in rows}:
        seen = 0
        for _, at, good in sorted(r for r in rows if r[0] == g):
            if seen < 7:
                want.add((g, at, good))
                seen += good
    table = spark.createDataFrame(rows, "g string, at long, good boolean").repartition(5)
    for parts in ("2", "9"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sample.first_valid(table, ["g"], ["at"], F.col("good"), 7)
        assert got.columns == ["g", "at", "good", "valid", "n_valid", "kept"]
        assert {(r["g"], r["at"], r["kept"]) for r in got.collect()} == want
        spark.conf.set("spark.sql.shuffle.partitions", before)
