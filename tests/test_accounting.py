"""Accounts observed on a write, balance of a two-way table, derivative manifests."""

import pytest
from pyspark.sql import functions as F

from evalmill.operators.contracts import ContractError
from evalmill.operators.stats import balance_report, demand_balance, grid_gaps
from evalmill.sources import accounting as Q
from evalmill.sources.committed import read_committed, read_manifest
from evalmill.sources.sinks import canonical_manifest, demand_canonical, derivative_digests, fresh_folder


def rows_of(df, *names):
    return {tuple(r[n] for n in names[:-1]): r[names[-1]] for r in df.collect()}


def numbers(spark, n=100):
    return spark.range(n).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("v")).repartition(5)


def test_rejects_are_counted_beside_the_write(spark):
    root = fresh_folder(spark, "t")
    found = rows_of(Q.write_accepted(numbers(spark), {"small": F.col("v") < 2, "odd": F.col("v") % 2 == 1, "never": F.lit(False)}, root), "reason", "n_rows")
    want = {}
    for i in range(100):
        v = i % 7 if i % 10 else None
        name = "accepted" if v is None else "small" if v < 2 else "odd" if v % 2 else "accepted"
        want[(name,)] = want.get((name,), 0) + 1
    assert found == want and read_committed(spark, root).count() == want[("accepted",)] == read_manifest(root)["rows"]
    with pytest.raises(ValueError):
        Q.write_accepted(numbers(spark), {"accepted": F.lit(True)}, root)


def test_the_input_is_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    Q.write_contract(numbers(spark).mapInArrow(run, "id long, v long"), {"there": F.col("v").isNotNull(), "low": F.col("v") < 5}, fresh_folder(spark, "t"))
    assert reads.value == 100


def test_contract_and_selection(spark):
    root = fresh_folder(spark, "t")
    found = rows_of(Q.write_contract(numbers(spark), {"there": F.col("v").isNotNull(), "low": F.col("v") < 5}, root), "rule", "n_rows")
    values = [i % 7 if i % 10 else None for i in range(100)]
    assert found == {("there",): 10, ("low",): sum(v is None or v >= 5 for v in values)}
    assert read_committed(spark, root).count() == sum(v is not None and v < 5 for v in values)
    found = rows_of(Q.write_selection(numbers(spark), {"v": (F.col("v"), [1, 2])}, fresh_folder(spark, "t")), "fact", "value", "n_rows")
    assert found == {("v", "1"): values.count(1), ("v", "2"): values.count(2), ("v", "missing"): 10, ("v", "other"): 90 - values.count(1) - values.count(2)}


def test_a_failed_write_publishes_nothing(spark):
    root = fresh_folder(spark, "t")
    broken = numbers(spark).withColumn("v", F.when(F.col("id") == 99, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception):
        Q.write_accepted(broken, {"small": F.col("v") < 2}, root)
    assert read_manifest(root)["commits"] == 0


def test_broken_cells_have_names(spark):
    full = spark.createDataFrame([(a, b) for a in "pqr" for b in range(5)], "a string, b long")
    demand_balance(full, "a", "b")
    assert grid_gaps(full, "a", "b").collect() == []
    broken = full.filter("NOT (a = 'q' AND b = 3) AND NOT (a = 'r' AND b IN (0, 4))").union(spark.createDataFrame([("p", 1), (None, 1)], full.schema))
    want = {("q", 3): 0, ("r", 0): 0, ("r", 4): 0, ("p", 1): 2}
    assert rows_of(grid_gaps(broken, "a", "b"), "a", "b", "n_rows") == want
    assert {(b, a): n for (b, a), n in rows_of(grid_gaps(broken, "b", "a"), "b", "a", "n_rows").items()} == {(b, a): n for (a, b), n in want.items()}
    report = balance_report(broken, "a", "b").first()
    assert (report["n_missing"], report["n_repeated"], report["n_unnamed"], report["balanced"]) == (3, 1, 1, False)
    with pytest.raises(ContractError, match="3 missing, 1 repeated, 1 rows without a name.*a=p, b=1: 2 rows"):
        demand_balance(broken, "a", "b")
    assert grid_gaps(full.limit(0), "a", "b").collect() == [] and not balance_report(full.limit(0), "a", "b").first()["balanced"]


def test_derivatives_with_two_labels_or_roles(spark):
    rows = spark.createDataFrame([(1, 0, "train", "A b"), (2, 1, "train", "a B"), (3, 0, "train", "c"), (4, 0, "eval", "C"), (5, 0, "eval", "d"), (6, 1, "train", None), (7, 0, "eval", None)], "id long, label int, role string, text string")
    found = canonical_manifest(derivative_digests(rows, "id", F.col("text"), F.lower("text")).join(rows.drop("text"), "id"), "label", "role")
    got = {r["id"]: (r["n_copies"], r["mixed_labels"], r["overlap"]) for r in found.collect()}
    assert got == {1: (2, True, False), 2: (2, True, False), 3: (2, False, True), 4: (2, False, True), 5: (1, False, False), 6: (1, False, False), 7: (1, False, False)}
    demand_canonical(found.filter("id >= 5"), "id")
    with pytest.raises(ValueError, match="more than one label|another role"):
        demand_canonical(found, "id")
