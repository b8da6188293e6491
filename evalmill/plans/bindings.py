"""The given tables seen as manifests, predictions, pairs, grids and vectors: as DataFrames and as SQL for the twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.operators.order import with_group_index

#: The evaluation conditions in order; a condition's place seeds its noise.
CONDITIONS = (
    "clean", "jpeg_q90", "jpeg_q70", "jpeg_q50", "jpeg_q30", "blur_sigma_0.5", "blur_sigma_1", "blur_sigma_2", "resize_0.5", "resize_0.25",
    "noise_sigma_0.02", "noise_sigma_0.05", "noise_sigma_0.10", "brightness_0.8", "brightness_1.2", "contrast_0.8", "contrast_1.2",
    "saturation_0.8", "saturation_1.2", "center_crop_80",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, sf_dir: str, label) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", label)


def _as_manifest(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        F.col("doc_id").alias("sample_id"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "label",
        F.when(F.col("label") == 1, F.col("source")).alias("generator"),
        F.when(F.col("label") == 0, F.col("lang")).alias("real_source"),
        F.sha2("text", 256).alias("content_sha256"),
        F.col("n_chars").alias("bytes"),
        *more,
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_manifest(_labelled(spark, sf_dir, F.col("toxic")))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_manifest(_labelled(spark, sf_dir, 1 - F.col("quality")))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).withColumn("role", F.when(F.col("sample_id") % 2 == 0, "train").otherwise("eval"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir, F.col("toxic")).withColumn("format", F.col("lang")).withColumn("mode", F.col("source")).withColumn("n_text", F.length("text"))
    return _as_manifest(rows, "format", "mode", F.col("n_text").cast("long").alias("n_text"), F.floor(F.col("n_chars") / 500).alias("size_bucket"))


def with_conditions(rows: DataFrame) -> DataFrame:
    """JN-19: each sample under each condition, by exploding the fixed catalogue."""
    catalogue = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("condition")) for i, n in enumerate(CONDITIONS)])
    return rows.withColumn("__c", F.explode(catalogue)).select("__c.idx", "__c.condition", *rows.columns)


def scored(rows: DataFrame, conditions: list[str]) -> DataFrame:
    """ML-05's place in a matrix run: (condition, label, generator, real_source, sample_id, score) of some conditions."""
    some = with_conditions(rows).filter(F.col("condition").isin(conditions))
    points = (F.col("sample_id") * 7919 + F.col("idx") * 104729) % 800 + F.col("label") * (200 - 8 * F.col("idx"))
    return some.select("condition", "label", "generator", "real_source", "sample_id", (points / F.lit(1000.0)).alias("score"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_conditions(manifest(spark, sf_dir))
    points = (F.col("sample_id") * 7919 + F.col("idx") * 104729) % 800 + F.col("label") * (200 - 8 * F.col("idx"))
    return rows.withColumn("score", points / F.lit(1000.0))


def predictions2(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = (F.col("sample_id") * 6101 + F.col("idx") * 15485863) % 800 + F.col("label") * 150
    return predictions(spark, sf_dir).withColumn("score_b", points / F.lit(1000.0))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("g"), (F.col("vec_id") % 10).cast("string")).alias("generator"), F.floor(F.col("vec_id") / 10).alias("prompt_id"), "vec_id", (((F.col("vec_id") * 7919) % 997) / F.lit(997.0)).alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    ranked = with_group_index(rows, "__at", ["label"], "content_sha256", "sample_id").withColumn("pair_id", F.col("__at") + 1).drop("__at")
    sizes = ranked.groupBy("label").agg(F.max("pair_id").alias("n")).agg(F.min("n").alias("n_pairs"))
    return ranked.join(F.broadcast(sizes), F.col("pair_id") <= F.col("n_pairs")).drop("n_pairs")


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    joined = lines.join(read("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return joined.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string")).alias("sample_id"),
        label.alias("label"), F.when(label == 1, F.col("p_brand")).alias("generator"), F.when(label == 0, F.col("n_name")).alias("real_source"), (cents % 10007 / F.lit(10007.0)).alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


_CONDITION_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(CONDITIONS))


def _manifest_sql(label: str) -> str:
    return f"""SELECT d.doc_id AS sample_id, concat('docs/', d.source, '/', CAST(d.doc_id AS VARCHAR), '.txt') AS path, {label} AS label,
  CASE WHEN {label} = 1 THEN d.source END AS generator, CASE WHEN {label} = 0 THEN d.lang END AS real_source, sha256(d.text) AS content_sha256, d.n_chars AS bytes"""


#: Name -> (views that it needs, SQL).
VIEWS = {
    "conditions_v": ((), f"SELECT * FROM (VALUES {_CONDITION_ROWS}) AS t(idx, condition)"),
    "manifest_v": ((), _manifest_sql("l.toxic") + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "quality_v": ((), _manifest_sql("(1 - l.quality)") + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "meta_v": ((), _manifest_sql("l.toxic") + ", d.lang AS format, d.source AS mode, length(d.text) AS n_text, d.n_chars // 500 AS size_bucket FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "split_v": (("manifest_v",), "SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'train' ELSE 'eval' END AS role FROM manifest_v"),
    "predictions_v": (("manifest_v", "conditions_v"), "SELECT c.idx, c.condition, m.*, ((m.sample_id * 7919 + c.idx * 104729) % 800 + m.label * (200 - 8 * c.idx)) / CAST(1000 AS DOUBLE) AS score FROM manifest_v m CROSS JOIN conditions_v c"),
    "predictions2_v": (("predictions_v",), "SELECT *, ((sample_id * 6101 + idx * 15485863) % 800 + label * 150) / CAST(1000 AS DOUBLE) AS score_b FROM predictions_v"),
    "grid_v": ((), "SELECT concat('g', CAST(vec_id % 10 AS VARCHAR)) AS generator, vec_id // 10 AS prompt_id, vec_id, ((vec_id * 7919) % 997) / CAST(997 AS DOUBLE) AS score FROM embeddings"),
    "pair_v": (("manifest_v",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY content_sha256, sample_id) AS pair_id FROM manifest_v) WHERE pair_id <= (SELECT min(n) FROM (SELECT count(*) AS n FROM manifest_v GROUP BY label))"),
    "big_v": ((), """SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS sample_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CASE WHEN l_returnflag = 'R' THEN p_brand END AS generator, CASE WHEN l_returnflag <> 'R' THEN n_name END AS real_source, (CAST(round(l_extendedprice * 100) AS BIGINT) % 10007) / CAST(10007 AS DOUBLE) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` with the views that it needs in front; a body may begin with more common table expressions after ``WITH``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
