"""Writers: ordered manifests, prediction tables with resume, content-addressed tables, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.columns import hash_rank, slug
from evalmill.operators.order import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path, as its file system says."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def refuses_overwrite(spark: SparkSession, path: str) -> bool:
    """SNK-03: whether a write to this output would be refused; nothing is written to find out."""
    return exists(spark, path)


def manifest_lines(rows: DataFrame, seed: int, name: str, key: str = "path") -> DataFrame:
    """SNK-02: JSON lines with sorted keys in a hashed order; (rank, value)."""
    columns = sorted(rows.columns)
    return rows.select(hash_rank(seed, name, F.col(key)).alias("rank"), F.to_json(F.struct(*columns)).alias("value"))


def write_manifest(rows: DataFrame, path: str, seed: int, name: str, key: str = "path") -> None:
    """SNK-02/03: fails if the output exists; duplicate paths are an error."""
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate {key} in {name}")
    manifest_lines(rows, seed, name, key).orderBy("rank").select("value").write.mode("errorifexists").text(path)


def prediction_array(scores: DataFrame, path: Column, score: Column) -> DataFrame:
    """SNK-01: one {image_path, pred} row for each input, by path."""
    return scores.select(path.alias("image_path"), score.alias("pred"))


def signature(**inputs) -> Column:
    """SNK-04: the digest of a run's inputs."""
    return F.sha2(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(inputs.items())])), 256)


def remaining_conditions(spark: SparkSession, wanted: list[str], done: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-04: conditions still to be scored, and finished ones that are unknown or come from other inputs."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in wanted])).alias("condition"))
    finished = done.select("condition", "signature").distinct()
    foreign = finished.join(names, "condition", "left").filter(~F.col("condition").isin(wanted) | (F.col("signature") != own))
    return names.join(finished.filter(F.col("signature") == own), "condition", "left_anti"), foreign


def write_condition(rows: DataFrame, path: str, own: Column) -> None:
    """SNK-04, UDF-05: a condition's predictions replace that condition's partition and no other."""
    rows.withColumn("signature", own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def content_addressed(rows: DataFrame, digest: str, path: str, size: str) -> DataFrame:
    """SNK-05: each content once with its first path, how many paths it has, and whether sizes agree; a prefix to partition by."""
    one = rows.groupBy(digest).agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("n_paths"), F.min(size).alias("bytes"), (F.min(size) == F.max(size)).alias("sizes_agree"))
    return one.withColumn("prefix", F.substring(digest, 1, 2))


def content_name(stem: Column, digest: Column, ending: str) -> Column:
    """SNK-07: a readable name that ends in the digest's beginning."""
    return F.concat(slug(stem), F.lit("-"), F.substring(digest, 1, 12), F.lit(ending))


def selection_report(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """SNK-08: tidy (fact, value, n_rows) counts of a build."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), c.cast("string").alias("value")) for n, c in groups.items()])).alias("x")).groupBy("x.fact", "x.value").agg(F.count(F.lit(1)).alias("n_rows"))


def derivative_digests(rows: DataFrame, key: str, source: Column, derived: Column) -> DataFrame:
    """SNK-06: (key, source_sha256, derived_sha256); taken where the contents lie, so no content goes through a shuffle."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(key, digest(source).alias("source_sha256"), digest(derived).alias("derived_sha256"))


def canonical_manifest(rows: DataFrame, label: str, role: str) -> DataFrame:
    """SNK-06: ``rows`` with their digests (``derivative_digests``) and n_copies, mixed_labels, overlap of their derivative.

    ``mixed_labels``: equal derivatives have different labels; ``overlap``: equal derivatives are in more than one role. A null derivative
    equals no other: it has no digest, one copy and neither fault.
    """
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    shared = rows.filter("derived_sha256 IS NOT NULL").groupBy("derived_sha256").agg(F.count(F.lit(1)).alias("n_copies"), differ(label).alias("mixed_labels"), differ(role).alias("overlap")).filter("n_copies > 1")
    rest = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("n_copies", 1), ("mixed_labels", False), ("overlap", False))]
    return rows.join(shared, "derived_sha256", "left").select(*rows.columns, *rest)


def demand_canonical(found: DataFrame, key: str) -> None:
    """SNK-06: raises with a row of a derivative that has two labels or is in two roles."""
    if bad := found.filter("mixed_labels OR overlap").first():
        raise ValueError(f"the derivative of {bad[key]} has " + ("more than one label" if bad["mixed_labels"] else "copies in another role"))
