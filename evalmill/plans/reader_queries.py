"""Queries on readers and writers: Spark writes files from the given tables to the shared folder and reads them by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import errors as E
from evalmill.operators import score as R
from evalmill.operators.order import cut_lineage
from evalmill.operators.stats import inventory_digest
from evalmill.plans import bindings as B
from evalmill.plans import kernel_sql as L
from evalmill.plans.bindings import sql
from evalmill.plans.registry import query
from evalmill.sources import committed as O
from evalmill.sources import images as I
from evalmill.sources import manifests as S
from evalmill.sources import sinks as W


@query("src04_sample_source", sql("SELECT path, label FROM manifest_v", "manifest_v"))
def src04(spark, d):
    folder = W.fresh_folder(spark, "samples") + ".jsonl"
    B.manifest(spark, d).select("path", "label").write.json(folder)
    return S.samples(spark, folder)


@query("src08_geometry_report", "SELECT label AS class, count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS n_broken FROM embeddings GROUP BY label")
def src08(spark, d):
    return S.geometry_report(B.vectors(spark, d), "label", "embedding", 64)


@query("src09_flagged_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents WHERE lang = 'en'")
def src09(spark, d):
    folder = W.fresh_folder(spark, "index")
    B.table(spark, d, "documents").select("doc_id", "lang", "source").write.option("header", True).csv(folder)
    return S.flagged_csv(spark, folder, "lang", "en")


@query("src12_json_array", "SELECT conv_id, turn, role FROM conversations")
def src12(spark, d):
    folder = W.fresh_folder(spark, "annotations")
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", "role")
    # Documents of at most 100 conversations, one file each, so that files grow in number and not in size.
    boxes = turns.groupBy(F.floor(F.col("conv_id") / 100)).agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("images"))
    boxes.select(F.to_json(F.struct("images")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    kinds = ",".join(f"{n}:{t}" for n, t in turns.dtypes)
    return S.json_array(spark, folder, "images", f"struct<{kinds}>")


@query("src14_condition_files", sql("SELECT condition, sample_id, label, score FROM predictions_v", "predictions_v"))
def src14(spark, d):
    folder = W.fresh_folder(spark, "predictions")
    rows = B.predictions(spark, d).select("sample_id", "label", "score", F.concat("condition", F.lit("_predictions.jsonl")).alias("file"))
    rows.repartition("file").write.partitionBy("file").json(folder)
    return S.condition_files(spark, f"{folder}/*_predictions.jsonl", "sample_id long, label int, score double")


@query("src18_manifest_mentions", sql("""SELECT value, lower(value) AS folded FROM (SELECT '{"label":' || label || ',"path":"' || path || '"}' AS value FROM manifest_v) WHERE contains(lower(value), '/src1/')""", "manifest_v"))
def src18(spark, d):
    folder = W.fresh_folder(spark, "manifests")
    B.manifest(spark, d).select("label", "path", F.coalesce("generator", "real_source").alias("kind")).write.partitionBy("kind").json(folder)
    return S.mentions(spark, folder, "/SRC1/", "*.json").select("value", F.lower("value").alias("folded"))


@query("snk03_refused_overwrite", sql("SELECT count(*) AS n_lines, true AS refused FROM manifest_v", "manifest_v"))
def snk03(spark, d):
    folder = W.fresh_folder(spark, "manifest")
    lines = W.manifest_lines(B.manifest(spark, d).select("path", "label"), 17, "train").select("value")
    fresh = W.refuses_overwrite(spark, folder)
    lines.write.mode("errorifexists").text(folder)
    refused = W.refuses_overwrite(spark, folder) and not fresh
    return spark.read.text(folder).agg(F.count("value").alias("n_lines")).withColumn("refused", F.lit(refused))


@query("snk01_committed_predictions", sql("SELECT path AS image_path, 0.75 * score + 0.25 * score_b AS pred, count(*) OVER () AS n_rows FROM predictions2_v WHERE condition = 'clean'", "predictions2_v"))
def snk01_committed(spark, d):
    """Written in one commit that counts its rows against the inputs, and read back by its manifest."""
    rows, root = B.predictions2(spark, d).filter("condition = 'clean'"), W.fresh_folder(spark, "predictions")
    O.write_predictions(rows, rows, root, "path", C.blend(F.col("score"), F.col("score_b"), 0.75))
    return O.read_committed(spark, root).withColumn("n_rows", F.lit(O.read_manifest(root)["rows"]).cast("long"))


PACKAGED = "SELECT content_sha256 AS sha256, CAST(min(bytes) AS BIGINT) AS bytes, concat('images/', substr(content_sha256, 1, 2), '/', content_sha256, '.txt') AS archive_path, CAST(sum(n) AS BIGINT) AS n_paths, substr(content_sha256, 1, 2) AS prefix"


@query("snk05_package_contents", sql(PACKAGED + " FROM (SELECT content_sha256, bytes, 1 AS n FROM manifest_v) GROUP BY content_sha256", "manifest_v"))
def snk05_contents(spark, d):
    """The contents of a package of two manifests of one name, read back."""
    rows, root = B.manifest(spark, d), W.fresh_folder(spark, "package")
    O.write_package({f"/{k}/list.jsonl": rows.filter(F.col("label") == k).select("path", "label", "content_sha256", "bytes") for k in (0, 1)}, root, "content_sha256", "path", "bytes")
    return O.read_committed(spark, f"{root}/contents")


@query("snk05_package_manifests", sql("SELECT concat('../images/', substr(content_sha256, 1, 2), '/', content_sha256, '.txt') AS path, content_sha256 AS image_sha256, label, CAST(bytes AS BIGINT) AS bytes, CASE WHEN label = 0 THEN 'list.jsonl' ELSE '1-list.jsonl' END AS manifest, true AS digest_kept FROM manifest_v", "manifest_v"))
def snk05_manifests(spark, d):
    """The rewritten rows of both manifests, each under a name of its own, read back; their digests are made once more from what was read."""
    rows, root = B.manifest(spark, d), W.fresh_folder(spark, "package")
    said = cut_lineage(O.write_package({f"/{k}/list.jsonl": rows.filter(F.col("label") == k).select("path", "label", "content_sha256", "bytes") for k in (0, 1)}, root, "content_sha256", "path", "bytes"))
    back = None
    for name in ("list.jsonl", "1-list.jsonl"):
        one = O.read_committed(spark, f"{root}/manifests/{name}")
        again = inventory_digest(one, F.to_json(F.struct(*sorted(one.columns)))).join(F.broadcast(said.filter(F.col("packaged_manifest") == name)), ["digest", "n_lines"]).count() == 1
        one = one.withColumn("manifest", F.lit(name)).withColumn("digest_kept", F.lit(again))
        back = one if back is None else back.unionByName(one)
    return back


@query("snk07_existing_contents", sql("SELECT content_sha256 AS sha256, CASE WHEN min(label) = 0 THEN 'known' ELSE 'new' END AS status FROM manifest_v GROUP BY content_sha256", "manifest_v"))
def snk07_existing(spark, d):
    """All contents after those of label 0 were written: those are compared and not written again."""
    rows, root = B.manifest(spark, d), W.fresh_folder(spark, "contents")
    O.write_contents(rows.filter("label = 0"), root, "content_sha256", "path", "bytes")
    return O.write_contents(rows, root, "content_sha256", "path", "bytes")


HALF = L.times(L.resize_weights(8, 4), L.resize_weights(4, 8))


@query("udf01_transform_callable", f"SELECT vec_id, {L.linear_sql(HALF, HALF, digits=6)} AS halved FROM embeddings")
def udf01(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (8, 8), "half").select("vec_id", F.transform("embedding", lambda x: C.signed_round(x, 6)).alias("halved"))


@query("udf03_error_predicate", sql("SELECT label, coalesce(generator, real_source) AS group_name, count(*) AS n_rows, count(*) FILTER (WHERE abs(score - label) > 0.75) AS n_errors, count(*) FILTER (WHERE abs(score - label) > 0.75) / CAST(count(*) AS DOUBLE) AS error_rate, round(avg(score), 9) AS mean_score FROM predictions_v GROUP BY 1, 2", "predictions_v"))
def udf03(spark, d):
    group = C.group_key(F.col("label"), F.col("generator"), F.col("real_source"))
    return E.group_errors(B.predictions(spark, d), [], group, F.abs(F.col("score") - F.col("label")) > 0.75)


@query("udf05_condition_callback", sql("SELECT condition, sample_id, CASE WHEN condition = 'jpeg_q50' THEN 1 - score ELSE score END AS score FROM predictions_v", "predictions_v"))
def udf05(spark, d):
    folder, own = W.fresh_folder(spark, "matrix"), W.signature(seed=7, source="corpus")
    rows = B.predictions(spark, d).select("condition", "sample_id", "score")
    W.write_condition(rows, folder, own)
    W.write_condition(rows.filter("condition = 'jpeg_q50'").withColumn("score", 1 - F.col("score")), folder, own)
    return spark.read.parquet(folder).select("condition", "sample_id", "score")


@query("ml06_unit_clusters")
def ml06(spark, d):
    return R.unit_clusters(B.vectors(spark, d), "vec_id", "embedding", 8, 5)


def image_folder(spark, d):
    """A picture of 4 x 5 pixels for each vector in a class folder, written by tasks into the shared folder."""
    folder = W.fresh_folder(spark, "images")
    named = B.vectors(spark, d).select(F.when(F.col("label") < 5, "real").otherwise("fake").alias("kind"), "vec_id", "embedding")
    return I.write_pictures(named, folder, "kind", "vec_id", "embedding", 4, 5)


CLASS = "CASE WHEN label < 5 THEN 'real' ELSE 'fake' END"


@query("src01_labelled_folder", f"SELECT {CLASS} || '/' || vec_id || '.png' AS name, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label FROM embeddings")
def src01(spark, d):
    return S.labelled_folder(spark, image_folder(spark, d)).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), "label")


@query("src05_image_listing", f"SELECT count(*) AS n_images, min({CLASS} || '/' || vec_id || '.png') AS first, max({CLASS} || '/' || vec_id || '.png') AS last FROM embeddings")
def src05(spark, d):
    names = S.image_listing(spark, image_folder(spark, d)).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"))
    return names.agg(F.count("name").alias("n_images"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("src19_file_metadata", f"SELECT {CLASS} || '/' || vec_id || '.png' AS name, 'PNG' AS format, 4 AS width, 5 AS height, 'RGB' AS mode FROM embeddings")
def src19(spark, d):
    found = I.file_metadata(spark, image_folder(spark, d))
    return found.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), "format", "width", "height", "mode")
