"""Decisions: frozen rules over a table of metrics, one engine for all rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule sets as (check, left metric, operator, right metric or null, number added to the right side).
RULES = {
    "arbitration": (
        ("official_margin", "official", ">=", "other_official", 0.02),
        ("clean_margin", "clean", ">=", "other_clean", -0.005),
        ("worst_margin", "worst_condition", ">=", "other_worst_condition", -0.03),
        ("clean_floor", "clean", ">=", None, 0.80),
        ("official_floor", "official", ">=", None, 0.75),
    ),
    "promotion": (("clean", "clean", ">=", None, 0.85), ("generator", "worst_generator", ">=", None, 0.65), ("source", "worst_source", ">=", None, 0.65), ("pair", "worst_pair", ">=", None, 0.60)),
    "semantic": (("clean", "clean", ">=", None, 0.70), ("paired", "paired_accuracy", ">=", None, 0.65), ("prompt", "worst_prompt", ">=", None, 0.55), ("official", "official", ">=", None, 0.65), ("transform", "worst_condition", ">=", None, 0.55)),
    "matched_source": (("clean", "clean", ">=", None, 0.80), ("transform", "worst_condition", ">=", None, 0.60)),
    "community": (("clean", "clean", ">=", None, 0.85), ("official", "official", ">=", None, 0.80), ("transform", "worst_condition", ">=", None, 0.70), ("pooled_model", "pooled_worst_generator", ">=", None, 0.50)),
    "arbitration_gate": (("clean", "clean", ">=", None, 0.75), ("official", "official", ">=", None, 0.70), ("transform", "worst_condition", ">=", None, 0.60)),
    "repair": (
        ("clean_drop", "clean", ">=", "other_clean", -0.01),
        ("noise_floor", "noise", ">=", None, 0.60),
        ("noise_gain", "noise", ">=", "other_noise", 0.05),
        ("noise_order", "noise_fake_mean", ">=", "noise_real_mean", 0.0),
        ("selection_clean_drop", "selection_clean", ">=", "other_selection_clean", -0.002),
        ("selection_pair_drop", "selection_pair", ">=", "other_selection_pair", -0.01),
        ("content_clean_drop", "content_clean", ">=", "other_content_clean", -0.002),
        ("content_pair_drop", "content_pair", ">=", "other_content_pair", -0.01),
    ),
    "routing_screen": (("clean_drop", "clean", ">=", "other_clean", -0.002), ("noise_kept", "noise", ">=", "other_noise", 0.0), ("clean_routed", "clean_route_rate", "<=", None, 0.05), ("noise_routed", "noise_route_rate", ">=", None, 0.95)),
    "routing_promotion": (
        ("clean_drop", "clean", ">=", "other_clean", -0.002),
        ("noise_floor", "noise", ">=", None, 0.70),
        ("noise_gain", "noise", ">=", "other_noise", 0.05),
        ("clean_routed", "clean_route_rate", "<=", None, 0.05),
        ("noise_routed", "noise_route_rate", ">=", None, 0.95),
        ("noise_order", "noise_fake_mean", ">=", "noise_real_mean", 0.0),
    ),
    "view_policy": (("official_gain", "selected_official", ">", "other_selected_official", 0.0), ("clean_drop", "clean", ">=", "other_clean", -0.002), ("stress_drop", "lowest_stress_delta", ">=", None, -0.01), ("noise_gain", "noise", ">", "other_noise", 0.0)),
    "flip_policy": (("official_gain", "official", ">", "other_official", 0.0), ("clean_drop", "clean", ">=", "other_clean", -0.002), ("noise_gain", "noise", ">", "other_noise", 0.0), ("all_drop", "lowest_delta", ">=", None, -0.01)),
    "ensemble": (
        ("clean_drop", "clean", ">=", "other_clean", -0.002),
        ("pooled_drop", "pooled", ">=", "other_pooled", -0.002),
        ("official_drop", "official", ">=", "other_official", -0.002),
        ("noise_drop", "noise", ">=", "other_noise", -0.01),
        ("clean_pair_drop", "worst_pair", ">=", "other_worst_pair", -0.01),
        ("pooled_pair_drop", "pooled_worst_pair", ">=", "other_pooled_worst_pair", -0.01),
    ),
    "ensemble_holdout": (("clean_gain", "clean", ">", "other_clean", 0.0), ("pair_gain", "worst_pair", ">", "other_worst_pair", 0.0), ("official_drop", "official", ">=", "other_official", -0.002)),
    "weight_grid": (("selection_clean", "clean", ">=", None, 0.979830), ("selection_pair", "worst_pair", ">=", None, 0.862510), ("content_clean", "content_clean", ">=", None, 0.992353), ("content_pair", "content_pair", ">=", None, 0.959759)),
}

COMPARE = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


def decide(metrics: DataFrame, keys: list[str], rules: tuple) -> DataFrame:
    """DEC-*: (keys, check, observed, bound, passes) from one wide row of metrics for each key; a missing metric doesn't pass."""
    cells = []
    for name, left, op, right, number in rules:
        observed = F.col(left).cast("double")
        bound = (F.col(right).cast("double") if right else F.lit(0.0)) + F.lit(float(number))
        cells.append(F.struct(F.lit(name).alias("check_name"), observed.alias("observed"), bound.alias("bound"), F.coalesce(COMPARE[op](observed, bound), F.lit(False)).alias("passes")))
    return metrics.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all checks of a key pass, and how many don't."""
    return checks.groupBy(*keys).agg(F.bool_and("passes").alias("passes_all"), F.count_if(~F.col("passes")).alias("n_failed"))


def choose(checks: DataFrame, yes: str, no: str) -> DataFrame:
    """DEC-01: the default where everything passes, the fallback otherwise."""
    return checks.agg(F.when(F.bool_and("passes"), yes).otherwise(no).alias("selected"))


def bands(value: Column, *steps: tuple[float, str], rest: str) -> Column:
    """DEC-04/14: the first band whose upper bound is above the value."""
    out = F
    for bound, name in steps:
        out = out.when(value < bound, name)
    return out.otherwise(rest)


def rank_candidates(metrics: DataFrame, name: str) -> DataFrame:
    """TOP-05, AGG-33: floor, harmonic mean with the clean AUC, veto below chance, and the order of candidates."""
    floor = F.least("worst_generator", "worst_source", "worst_pair")
    mean = F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), F.col("clean")) + F.try_divide(F.lit(1.0), F.col("floor")))
    out = metrics.withColumn("floor", floor).withColumn("harmonic_mean", mean).withColumn("veto", F.col("floor") < 0.5)
    return out.orderBy("veto", F.desc("harmonic_mean"), F.desc("floor"), F.desc("clean"), name)


def best_passing(metrics: DataFrame, checks: DataFrame, keys: list[str], *order) -> DataFrame:
    """TOP-06: the first passing candidate in the given order."""
    good = verdict(checks, keys).filter("passes_all").select(*keys)
    return metrics.join(good, keys, "left_semi").orderBy(*order).limit(1)
