"""Filters, exclusions, leakage checks, reconciliation and set operations on manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.columns import identities


def exclude(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """FLT-04/05/06: the rows without the listed keys, and the listed keys that no row has (an error for the caller)."""
    return rows.join(keys.select(on), on, "left_anti"), keys.select(on).join(rows.select(on), on, "left_anti")


def take_fresh(rows: DataFrame, used: DataFrame, on: str, order: list[str], count: int) -> DataFrame:
    """FLT-06: the first ``count`` rows in order that aren't used yet; a bounded top-k."""
    return rows.join(used.select(on), on, "left_anti").orderBy(*order).limit(count)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct by key, the first row in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def look_up(predictions: DataFrame, manifest: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """JN-01: predictions with their manifest columns, and predictions that have no row there."""
    return predictions.join(manifest, on), predictions.join(manifest.select(on), on, "left_anti")


def align(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JN-02..05: both sides' values and a verdict for each key: ok, missing on one side, or not unique."""
    side = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{n}"), F.max(value).alias(f"value_{n}"))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    verdict = F.when(F.col("n_a").isNull(), "missing_a").when(F.col("n_b").isNull(), "missing_b").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "not_unique").otherwise("ok")
    return both.select(*keys, "value_a", "value_b", verdict.alias("verdict"))


def dense_index(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """JN-03: whether the index of each key runs from 0 without gaps or repeats."""
    flat = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("n_distinct"))
    return flat.withColumn("dense", (F.col("low") == 0) & (F.col("high") == F.col("n_rows") - 1) & (F.col("n_distinct") == F.col("n_rows")))


def reconcile(rows: DataFrame, key: str, order: str, score: str, tolerance: float = 1e-6) -> DataFrame:
    """JN-06: one row for each hash; agreeing duplicates keep the first in order, others are conflicts."""
    flat = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_labels"), (F.max(score) - F.min(score)).alias("spread"), F.min_by(F.struct("label", F.col(score).alias("score")), order).alias("first"))
    return flat.select(key, "n_rows", "first.label", "first.score", ((F.col("n_labels") > 1) | (F.col("spread") > tolerance)).alias("conflict"))


def leakage(train: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """JN-08/10: for each identity column, held rows whose value occurs in training."""
    out = None
    for c in columns:
        one = held.join(train.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_semi").agg(F.lit(c).alias("identity"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def without_shared_identity(rows: DataFrame, prior: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN-09: rows that share no identity, in whichever column, with a prior row; one exploded anti join."""
    names = lambda df: df.select(*([key] if key in df.columns else []), F.explode(identities(*[F.col(c) for c in columns if c in df.columns])).alias("identity"))
    hit = names(rows).join(names(prior).select("identity").distinct(), "identity", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_anti")


def path_or_hash_excluded(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """JN-11: rows listed neither by path nor by hash, one for each hash."""
    kept = rows.join(listed.select("path").filter("path IS NOT NULL"), "path", "left_anti").join(listed.select("content_sha256").filter("content_sha256 IS NOT NULL"), "content_sha256", "left_anti")
    return first_of_each(kept, "content_sha256", ["path"])


def coverage(candidates: DataFrame, gate: DataFrame, name: str, family: str) -> DataFrame:
    """JN-21: names of the gate that no candidate has, by family, and their share."""
    seen = candidates.select(name).distinct().withColumn("seen", F.lit(True))
    names = gate.select(family, name).distinct().join(seen, name, "left")
    return names.groupBy(family).agg(F.count(F.lit(1)).alias("n_names"), F.count_if(F.col("seen").isNull()).alias("n_absent"), (F.count_if(F.col("seen").isNull()) / F.count(F.lit(1)).cast("double")).alias("absent_share"))


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """SET-05: contents that occur with both labels."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_labels")).filter("n_labels > 1")


def union_manifests(*parts: DataFrame) -> DataFrame:
    """SET-01: rows of manifests with different columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def stamp(rows: DataFrame, **values) -> DataFrame:
    """PRJ-04: constant provenance columns."""
    return rows.withColumns({name: F.lit(v) for name, v in values.items()})


def license_filter(rows: DataFrame, license: str, allowed: list, locator: Column) -> tuple[DataFrame, DataFrame]:
    """FLT-03: allowed rows with an acceptable locator, and counts of the excluded licences."""
    return rows.filter(F.col(license).isin(allowed) & locator), rows.filter(~F.col(license).isin(allowed)).groupBy(license).agg(F.count(F.lit(1)).alias("n_rows"))


def id_list_report(ids: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """FLT-10: size, distinct values and range of an id list, and whether it is valid."""
    flat = ids.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(column).alias("n_distinct"), F.min(column).alias("low"), F.max(column).alias("high"))
    return flat.withColumn("valid", (F.col("n_rows") == F.col("n_distinct")) & (F.col("low") >= low) & (F.col("high") <= high))


def rebase(path: Column, root: str) -> Column:
    """PRJ-05: a path relative to ``root``, or unchanged outside it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def gate_identity(gate: DataFrame, used: DataFrame, digest: str) -> DataFrame:
    """AGG-26: whether a gate's contents are unique, and how many of its rows a used set has too."""
    known = used.select(digest).distinct().withColumn("__used", F.lit(True))
    counts = gate.select(digest).groupBy(digest).agg(F.count(F.lit(1)).alias("n")).join(known, digest, "left")
    n, shared = F.sum("n"), F.coalesce(F.sum(F.when(F.col("__used"), F.col("n"))), F.lit(0))
    return counts.agg(n.alias("n_rows"), F.count(F.lit(1)).alias("n_contents"), (n == F.count(F.lit(1))).alias("unique_contents"), shared.alias("n_shared"), (shared == 0).alias("disjoint"))
