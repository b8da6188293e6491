"""SRC-07, SNK-08, CON-01: accounts of a build from the write itself, so its input is scanned once.

The counts are metrics that Spark observes on the rows that pass on their way into a committed output (``sources/committed.py``);
rejected rows are counted and go no further. No shuffle lies between the scan and the write, so the counting happens in the writing tasks,
and a task that ran twice is counted once. What was observed as accepted is held against what was published.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalmill.operators.contracts import ContractError
from evalmill.sources.committed import read_manifest, write_committed

ACCEPTED = "accepted"


def first_reason(rejects: dict[str, Column]) -> Column:
    """The name of the first rule that rejects a row, else 'accepted'; a null condition doesn't reject."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rejects.items()], F.lit(ACCEPTED))


def _observed_write(rows: DataFrame, keep: Column, metrics: list[tuple[tuple, Column]], root: str) -> dict[tuple, int]:
    """Publishes the rows to keep at ``root``; how many of all rows meet each named condition."""
    noted = Observation()
    aggregates = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"m{i}") for i, (_, c) in enumerate(metrics)]
    passing = rows.withColumn("__keep", F.coalesce(keep, F.lit(False))).observe(noted, F.count_if(F.col("__keep")).alias("kept"), *aggregates)
    before = read_manifest(root)["rows"]
    write_committed(passing.filter("__keep").drop("__keep"), root)
    written = read_manifest(root)["rows"] - before
    if noted.get["kept"] != written:
        raise ContractError(f"{noted.get['kept']} rows were accepted, {written} were written")
    return {name: noted.get[f"m{i}"] for i, (name, _) in enumerate(metrics)}


def _table(spark: SparkSession, counts: dict[tuple, int], *names: str) -> DataFrame:
    """The names and counts above 0; as many rows as there are rules."""
    return spark.createDataFrame([(*n, c) for n, c in counts.items() if c], ", ".join(f"{n} string" for n in names) + ", n_rows long")


def write_accepted(rows: DataFrame, rejects: dict[str, Column], root: str) -> DataFrame:
    """SRC-07: rows that no rule rejects are published at ``root``; (reason, n_rows) by the first rule that rejects, and 'accepted'.

    Reasons that no row has aren't listed; an empty table publishes an empty output.
    """
    if ACCEPTED in rejects:
        raise ValueError(f"{ACCEPTED} is no reason to reject")
    reason = first_reason(rejects)
    counts = _observed_write(rows, reason == ACCEPTED, [((n,), reason == n) for n in (*rejects, ACCEPTED)], root)
    return _table(rows.sparkSession, counts, "reason")


def write_contract(rows: DataFrame, rules: dict[str, Column], root: str) -> DataFrame:
    """CON-01: rows that keep all rules are published at ``root``; (rule, n_rows) of rows that break a rule. Null isn't true; a row may break several."""
    met = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    counts = _observed_write(rows, reduce(Column.__and__, met.values(), F.lit(True)), [((n,), ~c) for n, c in met.items()], root)
    return _table(rows.sparkSession, counts, "rule")


def write_selection(rows: DataFrame, facts: dict[str, tuple[Column, list]], root: str) -> DataFrame:
    """SNK-08: all rows are published at ``root``; (fact, value, n_rows) for the values that each fact names, 'other' and 'missing'."""
    metrics = []
    for fact, (column, values) in facts.items():
        known = column.isin(values) if values else F.lit(False)
        metrics += [((fact, str(v)), column == v) for v in values] + [((fact, "other"), column.isNotNull() & ~known), ((fact, "missing"), column.isNull())]
    return _table(rows.sparkSession, _observed_write(rows, F.lit(True), metrics, root), "fact", "value")
