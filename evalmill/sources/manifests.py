"""Readers of manifests, predictions, reports and images. Every reader gives a DataFrame; nothing is listed or parsed on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Class folder names, image suffixes.
REAL_NAMES, FAKE_NAMES = ("real", "authentic"), ("fake", "ai", "generated")
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")

MANIFEST = "path string, label int, real_source string, generator string, generator_model string, family string, archive_member string, image_sha256 string, prompt_id int"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01: (path, label, bytes) of images in class folders; content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    name = F.lower(F.element_at(F.split("path", "/"), -2))
    label = F.when(name.isin(*REAL_NAMES), 0).when(name.isin(*FAKE_NAMES), 1)
    return files.withColumn("label", label).filter(F.col("label").isNotNull() & suffix(F.col("path")).isin(*SUFFIXES)).select("path", "label", "bytes")


def image_listing(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05: unlabelled images, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    return files.filter(suffix(F.col("path")).isin(*SUFFIXES)).orderBy("path")


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """SRC-02: JSON lines with a broken line kept as ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def manifest_violations(rows: DataFrame) -> DataFrame:
    """SRC-02: (path, rule): broken lines, missing fields, labels outside {0, 1}, duplicate paths, unknown suffixes."""
    checks = {
        "bad_json": F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns else F.lit(False),
        "missing_path": F.col("path").isNull(),
        "bad_label": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "suffix": ~F.coalesce(suffix(F.col("path")).isin(*SUFFIXES, "txt"), F.lit(False)),
    }
    row = rows.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"))
    twice = rows.filter("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("duplicate_path").alias("rule"))
    return row.unionByName(twice)


def path_labels(rows: DataFrame) -> DataFrame:
    """SRC-03."""
    return rows.select("path", "label")


def samples(spark: SparkSession, source: str) -> DataFrame:
    """SRC-04: a folder or a JSON lines manifest."""
    return path_labels(manifest(spark, source)) if source.endswith((".jsonl", ".json")) else labelled_folder(spark, source).select("path", "label")


def provenance_manifest(rows: DataFrame, label: int | None = None, first: int | None = None, order: str = "path", forbidden: tuple = ()) -> DataFrame:
    """SRC-20: optional label filter, forbidden path parts, and the first n by a stored order."""
    out = rows if label is None else rows.filter(F.col("label") == label)
    if forbidden:
        out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in forbidden])))
    return out if first is None else out.orderBy(order).limit(first)


def embedded_images(rows: DataFrame, key: str, content: str, label: str) -> DataFrame:
    """SRC-06: key, content hash and size of rows with label 0 or 1; the third class is dropped in the scan."""
    return rows.filter(F.col(label).isin(0, 1)).select(key, F.col(label).alias("label"), F.sha2(F.col(content), 256).alias("content_sha256"), F.length(content).cast("long").alias("bytes"))


def reject_counts(rows: DataFrame, reason: Column) -> DataFrame:
    """SRC-07: rows by reject reason; accepted ones under 'accepted'."""
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def flagged_csv(spark: SparkSession, path: str, flag: str, value: str) -> DataFrame:
    """SRC-09: rows of a CSV index with one flag value; the filter is pushed into the scan."""
    return spark.read.option("header", True).csv(path).filter(F.col(flag) == value)


def geometry_report(rows: DataFrame, kind: str, values: str, size: int) -> DataFrame:
    """SRC-08: rows of each class and those whose array is missing or isn't ``size`` long."""
    broken = ~F.coalesce(F.size(values) == size, F.lit(False))
    return rows.groupBy(F.col(kind).alias("class")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(broken).alias("n_broken"))


def inventory_difference(files: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """SRC-10: keys on one side only."""
    both = files.select(key).distinct().withColumn("in_files", F.lit(True)).join(index.select(key).distinct().withColumn("in_index", F.lit(True)), key, "full")
    return both.filter("in_files IS NULL OR in_index IS NULL").select(key, F.coalesce("in_files", F.lit(False)).alias("in_files"), F.coalesce("in_index", F.lit(False)).alias("in_index"))


def index_contract(rows: DataFrame, expected: dict) -> DataFrame:
    """SRC-11: rows and rows that break one of the constant columns."""
    broken = F.greatest(*[~F.col(c).eqNullSafe(F.lit(v)) for c, v in expected.items()], F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(broken).alias("n_broken"))


def json_array(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """SRC-12: the elements of an array inside a JSON document as rows."""
    return spark.read.schema(f"`{field}` array<{element}>").option("multiLine", True).json(path).select(F.explode(field).alias("x")).select("x.*")


PROGRESS = "map<string,struct<labels:array<double>,scores:array<double>,paths:array<string>>>"


def progress_rows(documents: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """SRC-13: parallel arrays of each condition as rows, and conditions whose arrays differ in length or are empty."""
    entries = documents.select(F.explode(F.from_json(column, PROGRESS)).alias("condition", "p"))
    bad = entries.filter((F.size("p.labels") != F.size("p.scores")) | (F.size("p.labels") != F.size("p.paths")) | (F.size("p.labels") == 0)).select("condition")
    rows = entries.select("condition", F.posexplode(F.arrays_zip("p.labels", "p.scores", "p.paths")).alias("position", "z"))
    return rows.select("condition", "position", F.col("z.labels").cast("int").alias("label"), F.col("z.scores").alias("score"), F.col("z.paths").alias("path")), bad


def condition_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """SRC-14: prediction files, the condition taken from the file's name."""
    return spark.read.schema(schema).json(pattern).withColumn("condition", F.regexp_extract(F.input_file_name(), r"([^/=]+)_predictions\.jsonl", 1))


def report_metrics(reports: DataFrame, column: str) -> DataFrame:
    """SRC-15: one metric row from either report layout (the last entry of a history, or a selection)."""
    kind = "arguments struct<model:string>, model string, history array<struct<clean_auc:double,worst_pair_auc:double>>, selection_clean struct<clean_auc:double,worst_pair_auc:double>"
    r = reports.select(F.from_json(column, kind).alias("r"))
    last = F.try_element_at("r.history", F.lit(-1))
    return r.select(F.coalesce("r.arguments.model", "r.model").alias("model"), F.coalesce(last["clean_auc"], F.col("r.selection_clean.clean_auc")).alias("clean_auc"), F.coalesce(last["worst_pair_auc"], F.col("r.selection_clean.worst_pair_auc")).alias("worst_pair_auc"))


def evaluation_groups(reports: DataFrame, column: str) -> DataFrame:
    """SRC-16: a nested evaluation report as (condition, generator, auc) rows."""
    e = reports.select(F.explode(F.from_json(column, "map<string,struct<auc:double,groups:map<string,double>>>")).alias("condition", "c"))
    return e.select("condition", F.col("c.auc").alias("condition_auc"), F.explode("c.groups").alias("generator", "auc"))


def mentions(spark: SparkSession, root: str, term: str, files: str = "*.jsonl") -> DataFrame:
    """SRC-18: lines of all manifests under a folder that mention a term, with their file; unreadable files are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).option("ignoreCorruptFiles", True).text(root)
    return lines.filter(F.contains(F.lower("value"), F.lit(term.lower()))).select(F.col("_metadata.file_path").alias("file"), "value")


def ordered_rows(rows: DataFrame, partition: str, order: str, name: str = "index") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1)
