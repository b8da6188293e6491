"""Contracts: rules on rows and on groups become one table of violations, found in a single scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract has violations."""


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """CON-01..09: (key, rule) for each rule that a row breaks. A rule is a condition that must be true; null isn't true."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule"))


def duplicate_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """CON-02: values that occur in more than one row, with the column's name as the rule."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(f"unique_{c}").alias("rule"), F.col(c).cast("string").alias("row_key")) for c in columns])).alias("x")).select("x.rule", "x.row_key")
    return values.groupBy("rule", "row_key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def paired_violations(rows: DataFrame, pair: str, constant: list[str]) -> DataFrame:
    """CON-03: pairs that aren't two rows with labels {0, 1}, or whose metadata differ."""
    flat = rows.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"), F.count_distinct("label").alias("l"), *[F.count_distinct(c).alias(f"d_{c}") for c in constant])
    return violations(flat, pair, {"two_rows": F.col("n") == 2, "both_labels": (F.col("l") == 2) & (F.col("s") == 1), **{f"constant_{c}": F.col(f"d_{c}") <= 1 for c in constant}})


def score_violations(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """CON-08: labels outside {0, 1}, scores that are null, not finite or outside [0, 1]."""
    s = F.col(score)
    return violations(rows, key, {"label": F.col("label").isin(0, 1), "finite": s.isNotNull() & ~F.isnan(s), "range": s.between(0, 1)})


def demand_none(found: DataFrame, limit: int = 5) -> None:
    """Raises with a few of the violations, if there are any."""
    rows = found.limit(limit).collect()
    if rows:
        raise ContractError("; ".join(str(r.asDict()) for r in rows))
