"""Queries on readers, writers, kernels, models and composed jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import conditions as N
from evalmill.operators import metrics as M
from evalmill.operators import sample as P
from evalmill.operators import score as R
from evalmill.operators import training as G
from evalmill.operators.order import with_group_index
from evalmill.plans import bindings as B
from evalmill.plans import jobs as J
from evalmill.plans import kernel_sql as L
from evalmill.plans.bindings import sql
from evalmill.plans.metric_queries import auc_sql, grouped_sql
from evalmill.plans.registry import query
from evalmill.plans.stat_queries import rank_sql
from evalmill.sources import accounting as Q
from evalmill.sources import manifests as S
from evalmill.sources import sinks as W
from evalmill.sources.committed import read_committed, write_committed


@query("src02_manifest_violations", sql("""WITH r AS (SELECT CASE WHEN sample_id % 17 = 0 THEN NULL ELSE path END AS path, CASE WHEN sample_id % 13 = 0 THEN 2 ELSE label END AS label FROM manifest_v UNION ALL SELECT path, label FROM quality_v)
SELECT path, 'missing_path' AS rule FROM r WHERE path IS NULL UNION ALL SELECT path, 'bad_label' FROM r WHERE label NOT IN (0, 1) UNION ALL SELECT path, 'suffix' FROM r WHERE path IS NULL UNION ALL SELECT path, 'duplicate_path' FROM r WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1""", "manifest_v", "quality_v"))
def src02(spark, d):
    rows = B.manifest(spark, d)
    broken = rows.select(F.when(F.col("sample_id") % 17 != 0, F.col("path")).alias("path"), F.when(F.col("sample_id") % 13 == 0, 2).otherwise(F.col("label")).alias("label"))
    return S.manifest_violations(broken.unionByName(B.quality(spark, d).select("path", "label")))


@query("src03_path_labels", sql("SELECT path, label FROM manifest_v", "manifest_v"))
def src03(spark, d):
    return S.path_labels(B.manifest(spark, d))


@query("src06_embedded_content", "SELECT doc_id, quality + toxic AS label, sha256(text) AS content_sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents JOIN labels USING (doc_id) WHERE quality + toxic IN (0, 1)")
def src06(spark, d):
    rows = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id").select("doc_id", F.col("text").cast("binary").alias("content"), (F.col("quality") + F.col("toxic")).alias("kind"))
    return S.embedded_images(rows, "doc_id", "content", "kind")


@query("src07_reject_counts", "SELECT CASE WHEN lang <> 'en' THEN 'lang' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM documents GROUP BY 1")
def src07(spark, d):
    reason = F.when(F.col("lang") != "en", "lang").when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 5000, "long")
    return S.reject_counts(B.table(spark, d, "documents").select("lang", "n_chars"), reason)


@query("src07_accounted_write", "SELECT CASE WHEN lang <> 'en' THEN 'lang' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM documents GROUP BY 1")
def src07b(spark, d):
    rejects = {"lang": F.col("lang") != "en", "short": F.col("n_chars") < 200, "long": F.col("n_chars") > 5000}
    return Q.write_accepted(B.table(spark, d, "documents"), rejects, W.fresh_folder(spark, "accepted"))


@query("con01_accounted_write", """SELECT rule, count(*) AS n_rows FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars >= 300, false) THEN 'size' END,
CASE WHEN NOT coalesce(length(text) = n_chars, false) THEN 'length' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY rule""")
def con01b(spark, d):
    rules = {"lang": F.col("lang").isin("en", "de", "fr"), "size": F.col("n_chars") >= 300, "length": F.length("text") == F.col("n_chars")}
    return Q.write_contract(B.table(spark, d, "documents"), rules, W.fresh_folder(spark, "contract"))


@query("snk08_accounted_write", """SELECT 'lang' AS fact, CASE WHEN lang IS NULL THEN 'missing' WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS value, count(*) AS n_rows FROM documents GROUP BY 2
UNION ALL SELECT 'long', CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars > 5000 THEN '1' ELSE '0' END, count(*) FROM documents GROUP BY 2""")
def snk08b(spark, d):
    facts = {"lang": (F.col("lang"), ["en", "de"]), "long": ((F.col("n_chars") > 5000).cast("int"), [0, 1])}
    return Q.write_selection(B.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), facts, W.fresh_folder(spark, "selection"))


@query("src10_inventory_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_files, b.doc_id IS NOT NULL AS in_index FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def src10(spark, d):
    return S.inventory_difference(B.table(spark, d, "documents").filter("lang = 'en'"), B.table(spark, d, "labels"), "doc_id")


@query("src11_index_contract", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE lang <> 'en' OR source <> 'src1') AS n_broken FROM documents")
def src11(spark, d):
    return S.index_contract(B.table(spark, d, "documents"), {"lang": "en", "source": "src1"})


@query("src13_progress_rows", sql("SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY sample_id) - 1 AS position, label, score, path FROM predictions_v", "predictions_v"))
def src13(spark, d):
    # A progress document holds a stretch of 1,000 rows of its condition; positions count on over the stretches.
    placed = with_group_index(B.predictions(spark, d).select("condition", "sample_id", "label", "score", "path"), "at", ["condition"], "sample_id")
    cells = placed.groupBy("condition", F.floor(F.col("at") / 1000).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("sample_id", "label", "score", "path"))).alias("c"))
    parts = F.struct(F.transform("c", lambda x: x["label"].cast("double")).alias("labels"), F.transform("c", lambda x: x["score"]).alias("scores"), F.transform("c", lambda x: x["path"]).alias("paths"))
    name = F.concat_ws("\t", "condition", F.col("stretch").cast("string"))
    rows = S.progress_rows(cells.select(F.to_json(F.create_map(name, parts)).alias("doc")), "doc")[0]
    position = F.element_at(F.split("condition", "\t"), -1).cast("long") * 1000 + F.col("position")
    return rows.select(F.element_at(F.split("condition", "\t"), 1).alias("condition"), position.alias("position"), "label", "score", "path")


@query("src15_report_layouts", sql("WITH a AS (WITH " + auc_sql("predictions_v", ["condition"])[5:] + ") SELECT condition AS model, auc AS clean_auc, auc / 2 AS worst_pair_auc FROM a", "predictions_v"))
def src15(spark, d):
    rows = M.auc(B.predictions(spark, d), ["condition"])
    metrics = F.struct(F.col("auc").alias("clean_auc"), (F.col("auc") / 2).alias("worst_pair_auc"))
    empty = F.struct(F.lit(0.0).alias("clean_auc"), F.lit(0.0).alias("worst_pair_auc"))
    history = F.to_json(F.struct(F.struct(F.col("condition").alias("model")).alias("arguments"), F.array(empty, metrics).alias("history")))
    selection = F.to_json(F.struct(F.col("condition").alias("model"), metrics.alias("selection_clean")))
    return S.report_metrics(rows.select(F.when(F.length("condition") % 2 == 0, history).otherwise(selection).alias("doc")), "doc")


@query("src16_nested_report", sql(grouped_sql("predictions_v", ["condition"], "SELECT condition, condition_auc, generator, auc FROM (SELECT condition, max(auc) FILTER (WHERE level = 'all') OVER (PARTITION BY condition) AS condition_auc, level, generator, auc FROM grp) WHERE level = 'generator'"), "predictions_v"))
def src16(spark, d):
    groups = M.grouped_auc(B.predictions(spark, d), ["condition"])
    folded = groups.groupBy("condition").agg(F.struct(F.max(F.when(F.col("level") == "all", F.col("auc"))).alias("auc"), F.map_from_entries(F.collect_list(F.when(F.col("level") == "generator", F.struct("generator", "auc")))).alias("groups")).alias("c"))
    return S.evaluation_groups(folded.select(F.to_json(F.create_map("condition", "c")).alias("doc")), "doc")


@query("src17_prompt_rows", "SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def src17(spark, d):
    return B.table(spark, d, "benchmark").join(B.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti").select("item_id", "text")


@query("src20_provenance_manifest", sql("SELECT path, label FROM manifest_v WHERE label = 0 AND NOT list_contains(string_split(path, '/'), 'src2') ORDER BY path LIMIT 60", "manifest_v"))
def src20(spark, d):
    return S.provenance_manifest(B.manifest(spark, d), label=0, first=60, forbidden=("src2",)).select("path", "label")


@query("snk01_prediction_array", sql("SELECT path AS image_path, 0.75 * score + 0.25 * score_b AS pred FROM predictions2_v WHERE condition = 'clean'", "predictions2_v"))
def snk01(spark, d):
    return W.prediction_array(B.predictions2(spark, d).filter("condition = 'clean'"), F.col("path"), C.blend(F.col("score"), F.col("score_b"), 0.75))


@query("snk02_manifest_lines", sql("SELECT " + rank_sql(17, "train", "path") + """ AS rank, '{"label":' || label || ',"path":"' || path || '"}' AS value FROM manifest_v""", "manifest_v"))
def snk02(spark, d):
    return W.manifest_lines(B.manifest(spark, d).select("path", "label"), 17, "train")


@query("snk04_remaining_conditions", sql("SELECT condition FROM conditions_v WHERE idx % 3 <> 0", "conditions_v"))
def snk04(spark, d):
    own = W.signature(seed=7, source="corpus")
    done = B.predictions(spark, d).filter("idx % 3 = 0").select("condition", own.alias("signature"))
    return W.remaining_conditions(spark, list(B.CONDITIONS), done, own)[0]


@query("snk05_content_addressed", sql("SELECT content_sha256, min(path) AS first_path, count(*) AS n_paths, min(bytes) AS bytes, min(bytes) = max(bytes) AS sizes_agree, substr(content_sha256, 1, 2) AS prefix FROM manifest_v GROUP BY content_sha256", "manifest_v"))
def snk05(spark, d):
    return W.content_addressed(B.manifest(spark, d), "content_sha256", "path", "bytes")


@query("snk06_canonical_collisions", "WITH c AS (SELECT doc_id, toxic, sha256(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS derived FROM documents JOIN labels USING (doc_id)) SELECT derived, count(*) AS n_rows, count(DISTINCT toxic) AS n_labels FROM c GROUP BY derived HAVING count(*) > 1")
def snk06(spark, d):
    rows = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    derived = rows.select("toxic", F.sha2(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), 256).alias("derived"))
    return derived.groupBy("derived").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("toxic").alias("n_labels")).filter("n_rows > 1")


@query("snk06_derivative_manifest", """WITH c AS (SELECT doc_id, toxic, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS role, sha256(text) AS source_sha256, sha256(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS derived_sha256 FROM documents JOIN labels USING (doc_id))
SELECT *, count(*) OVER w AS n_copies, min(toxic) OVER w <> max(toxic) OVER w AS mixed_labels, min(role) OVER w <> max(role) OVER w AS overlap FROM c WINDOW w AS (PARTITION BY derived_sha256)""")
def snk06b(spark, d):
    digests = W.derivative_digests(B.table(spark, d, "documents"), "doc_id", F.col("text"), F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    rows = digests.join(B.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").withColumn("role", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval"))
    found = W.canonical_manifest(rows, "toxic", "role")
    root = W.fresh_folder(spark, "canonical")
    write_committed(found, root)
    return read_committed(spark, root)


@query("snk07_content_names", sql("SELECT sample_id, concat(left(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-', substr(content_sha256, 1, 12), '.txt') AS name FROM manifest_v", "manifest_v"))
def snk07(spark, d):
    return B.manifest(spark, d).select("sample_id", W.content_name(F.col("path"), F.col("content_sha256"), ".txt").alias("name"))


@query("snk08_selection_report", sql("SELECT 'label' AS fact, CAST(label AS VARCHAR) AS value, count(*) AS n_rows FROM manifest_v GROUP BY 2 UNION ALL SELECT 'generator', generator, count(*) FROM manifest_v GROUP BY 2", "manifest_v"))
def snk08(spark, d):
    return W.selection_report(B.manifest(spark, d), {"label": F.col("label"), "generator": F.col("generator")})


@query("agg37_inventory_totals", "SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def agg37(spark, d):
    return B.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_bytes"))


@query("krn04_noise_estimate", "WITH x AS (SELECT vec_id, list_sort(list_transform(range(0, 32), lambda i: abs(CAST(embedding[2 * i + 1] AS DOUBLE) - CAST(embedding[2 * i + 2] AS DOUBLE)) / 1.4142135623730951)) AS s FROM embeddings) SELECT vec_id, round(s[16] / 0.67448975, 9) AS noise FROM x")
def krn04(spark, d):
    return B.vectors(spark, d).select("vec_id", F.round(C.pair_noise(F.col("embedding")), 9).alias("noise"))


HAAR_SQL = "abs(" + " ".join(f"{sign} CAST(embedding[(k // 4) * 16 + (k % 4) * 2 + {at}] AS DOUBLE)" for sign, at in (("", 1), ("-", 2), ("-", 9), ("+", 10))) + ") / 2"


@query("krn04_haar_noise", f"SELECT vec_id, round(list_sort(list_transform(range(0, 16), lambda k: {HAAR_SQL}))[8] / 0.67448975, 9) AS noise FROM embeddings")
def krn04_haar(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (8, 8), "noise").select("vec_id", F.round(F.get("embedding", 0), 9).alias("noise"))


@query("krn06_colours", """WITH m AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS mean FROM embeddings), y AS (SELECT *, list_transform(range(0, 21), lambda i: 0.299::DOUBLE * CAST(embedding[3 * i + 1] AS DOUBLE) + 0.587::DOUBLE * CAST(embedding[3 * i + 2] AS DOUBLE) + 0.114::DOUBLE * CAST(embedding[3 * i + 3] AS DOUBLE)) AS luma FROM m)
SELECT vec_id, list_transform(embedding, lambda x: round(mean + (CAST(x AS DOUBLE) - mean) * 1.2, 6)) AS contrasted, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 0.8, 6)) AS darkened, list_transform(range(0, 63), lambda i: round(luma[i // 3 + 1] + (CAST(embedding[i + 1] AS DOUBLE) - luma[i // 3 + 1]) * 0.8, 6)) AS less_saturated FROM y""")
def krn06_colours(spark, d):
    v, rounded = F.col("embedding"), lambda c: F.transform(c, lambda x: C.signed_round(x, 6))
    return B.vectors(spark, d).select("vec_id", rounded(C.contrast(v, 1.2)).alias("contrasted"), rounded(C.brightness(v, 0.8)).alias("darkened"), rounded(C.saturation(F.slice(v, 1, 63), 0.8)).alias("less_saturated"))


@query("krn08_down_up_whole", "SELECT vec_id, list_transform(range(0, 64), lambda i: round((CAST(embedding[2 * (i // 2) + 1] AS DOUBLE) + CAST(embedding[2 * (i // 2) + 2] AS DOUBLE)) / 2, 9)) AS resized FROM embeddings")
def krn08_whole(spark, d):
    return B.vectors(spark, d).select("vec_id", F.transform(C.pooled_resize(F.col("embedding"), 2), lambda x: C.signed_round(x, 9)).alias("resized"))


@query("krn05_condition_catalogue", sql("SELECT c.idx, c.condition, count(m.sample_id) AS n_samples FROM conditions_v c CROSS JOIN manifest_v m GROUP BY 1, 2", "conditions_v", "manifest_v"))
def krn05(spark, d):
    return B.with_conditions(B.manifest(spark, d).select("sample_id")).groupBy("idx", "condition").agg(F.count("sample_id").alias("n_samples"))


@query("krn06_contrast", "WITH m AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS mean FROM embeddings) SELECT vec_id, round(mean + (CAST(embedding[1] AS DOUBLE) - mean) * 1.2, 6) AS first_contrast, round(CAST(embedding[1] AS DOUBLE) * 0.8, 6) AS first_brightness FROM m")
def krn06(spark, d):
    v = F.col("embedding")
    return B.vectors(spark, d).select("vec_id", C.signed_round(C.contrast(v, 1.2)[0], 6).alias("first_contrast"), C.signed_round(C.brightness(v, 0.8)[0], 6).alias("first_brightness"))


@query("krn07_centre_crop", "SELECT vec_id, embedding[7:57] AS cropped FROM embeddings")
def krn07(spark, d):
    return B.vectors(spark, d).select("vec_id", C.centre_crop(F.col("embedding"), 0.8).alias("cropped"))


@query("krn08_down_up", "SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2, 9) AS first_mean FROM embeddings")
def krn08(spark, d):
    return B.vectors(spark, d).select("vec_id", C.signed_round(C.pooled_resize(F.col("embedding"), 2)[1], 9).alias("first_mean"))


NOISE_U = "(CAST(('0x' || substr(sha256(concat_ws(':', '7', 'noise', '11', vec_id, i - 1, {})), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE + 0.5::DOUBLE / 281474976710656.0::DOUBLE)"


@query("krn09_hashed_noise", f"SELECT vec_id, list_transform(embedding, lambda x, i: round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(x AS DOUBLE) + 0.05::DOUBLE * sqrt(-2 * ln({NOISE_U.format(0)})) * cos(6.283185307179586::DOUBLE * {NOISE_U.format(1)}))), 9)) AS noisy FROM embeddings")
def krn09(spark, d):
    rows = B.vectors(spark, d)
    return rows.select("vec_id", F.transform(C.gaussian_noise(F.col("embedding"), 0.05, 7, F.lit(11), F.col("vec_id")), lambda x: F.round(x, 9)).alias("noisy"))


@query("krn11_flip", "SELECT vec_id, list_reverse(embedding) AS flipped FROM embeddings")
def krn11(spark, d):
    return B.vectors(spark, d).select("vec_id", C.flipped(F.col("embedding")).alias("flipped"))


UNIT = "(CAST(('0x' || substr({r}, 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query("krn14_hashed_patch", f"WITH o AS (SELECT vec_id, embedding, CAST(floor({UNIT.format(r=rank_sql(5, 'patch', 'vec_id'))} * 49) AS BIGINT) AS o FROM embeddings) SELECT vec_id, embedding[o + 1:o + 16] AS patch FROM o")
def krn14(spark, d):
    return B.vectors(spark, d).select("vec_id", C.hashed_patch(F.col("embedding"), 16, 5, F.col("vec_id")).alias("patch"))


@query("krn15_ratio_bucket", f"SELECT vec_id, CAST(floor({UNIT.format(r=rank_sql(5, 'ratio', 'vec_id'))} * 4) AS INTEGER) AS bucket FROM embeddings")
def krn15(spark, d):
    return B.vectors(spark, d).select("vec_id", C.ratio_bucket(5, F.col("vec_id")).alias("bucket"))


@query("krn15_ratio_crop", f"WITH b AS (SELECT vec_id, embedding, CAST(floor({UNIT.format(r=rank_sql(5, 'ratio', 'vec_id'))} * 4) AS INTEGER) AS bucket FROM embeddings), w AS (SELECT *, greatest(1, CAST(floor(64 / [1.0, 1.25, 1.5, 2.0][bucket + 1]) AS BIGINT)) AS keep FROM b) SELECT vec_id, embedding[(64 - keep) // 2 + 1 : (64 - keep) // 2 + keep] AS cropped FROM w")
def krn15_crop(spark, d):
    return B.vectors(spark, d).select("vec_id", C.ratio_crop(F.col("embedding"), C.ratio_bucket(5, F.col("vec_id")), [1.0, 1.25, 1.5, 2.0]).alias("cropped"))


@query("krn16_metadata_features", sql("SELECT sample_id, round(ln(1 + bytes), 9) AS log_bytes, round(ln(1 + n_text), 9) AS log_length, round(bytes / CAST(n_text AS DOUBLE), 9) AS aspect, bytes = n_text AS is_square, format, mode FROM meta_v", "meta_v"))
def krn16(spark, d):
    return B.meta(spark, d).select("sample_id", F.round(F.log1p("bytes"), 9).alias("log_bytes"), F.round(F.log1p("n_text"), 9).alias("log_length"), F.round(F.col("bytes") / F.col("n_text"), 9).alias("aspect"), (F.col("bytes") == F.col("n_text")).alias("is_square"), "format", "mode")


@query("krn17_kernel_chain", f"SELECT vec_id, {L.linear_sql(L.blur_weights(8, 1.0), L.mirrored(L.blur_weights(8, 1.0)))} AS embedding FROM embeddings")
def krn17(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (8, 8), "flip_blur").select("vec_id", F.transform("embedding", lambda x: C.signed_round(x, 9)).alias("embedding"))


@query("ml01_shortcut_probe")
def ml01(spark, d):
    rows = B.meta(spark, d).withColumn("log_bytes", F.log1p("bytes")).withColumn("log_text", F.log1p("n_text")).select("sample_id", "label", "log_bytes", "log_text", "format", "mode")
    scored = R.shortcut_probe(rows.filter("sample_id % 2 = 0"), rows.filter("sample_id % 2 = 1"), ["log_bytes", "log_text"], ["format", "mode"], "sample_id")
    return M.auc(scored).select("n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("ml02_single_rule_auc", sql("WITH r AS (SELECT label, CASE WHEN format = 'en' THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM meta_v), " + auc_sql("r", [])[5:], "meta_v"))
def ml02(spark, d):
    return M.auc(B.meta(spark, d).withColumn("score", F.when(F.col("format") == "en", 1.0).otherwise(0.0)))


def _embedded(spark, d):
    return B.vectors(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))


@query("ml03_weighted_head")
def ml03(spark, d):
    rows = _embedded(spark, d).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(2.0))
    model = R.linear_head(rows.filter("vec_id % 2 = 0"), "embedding", "weight")
    return R.head_scores(model, rows.filter("vec_id % 2 = 1"), "embedding", "vec_id").select("vec_id", F.round("score", 4).alias("score"))


@query("ml04_non_negative_head")
def ml04(spark, d):
    rows = _embedded(spark, d)
    model = R.linear_head(rows, "embedding", non_negative=True)
    return R.head_scores(model, rows, "embedding", "vec_id").select("vec_id", F.round("score", 4).alias("score"))


def epochs_sql(epochs: int, rate: float, floor: str) -> str:
    """Losses of full-batch steps: each epoch's gradient is a row of lists that the next one reads; ``floor`` clamps a weight."""
    group = "CASE WHEN label >= 5 THEN 1 ELSE 0 END"
    parts = [f"n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT {group} AS y, count(*) AS k FROM n GROUP BY 1)", f"x0 AS (SELECT e.vec_id, {group} AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, 1 / CAST(k.k * n.n AS DOUBLE) AS w FROM embeddings e JOIN n USING (label) JOIN k ON k.y = {group})", "h0 AS (SELECT list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS t, 0.0::DOUBLE AS b)"]
    for i in range(epochs):
        parts.append(f"o{i} AS (SELECT y, x, w, list_sum(list_transform(range(1, 65), lambda j: x[j] * t[j])) + b AS o FROM x0 CROSS JOIN h{i})")
        parts.append(f"e{i} AS (SELECT y, x, w, o, w * (1 / (1 + exp(-o)) - y) AS e FROM o{i})")
        parts.append(f"g{i} AS (SELECT j, sum(e * x[j]) AS g FROM e{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS j) GROUP BY j)")
        parts.append(f"s{i} AS (SELECT sum(e) AS e, sum(w) AS w, sum(w * (greatest(o, 0) + ln(1 + exp(-abs(o))) - y * o)) AS l FROM e{i})")
        moved = f"t[j] - {rate}::DOUBLE * g / w"
        parts.append(f"h{i + 1} AS (SELECT list({floor.format(moved)} ORDER BY j) AS t, any_value(b - {rate}::DOUBLE * e / w) AS b FROM g{i} CROSS JOIN s{i} CROSS JOIN h{i})")
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT {i + 1} AS epoch, round(l / w, 9) AS loss FROM s{i}" for i in range(epochs))


def trained(spark, d, **options):
    """A head for labels from 5 on, each label's rows sharing its mass (SMP-15)."""
    rows = B.vectors(spark, d).withColumnRenamed("label", "kind").withColumn("label", (F.col("kind") >= 5).cast("int"))
    weighted = P.balanced_weights(rows, F.col("kind").cast("string"))
    return weighted, G.train_head(weighted, "vec_id", "embedding", "label", "weight", epochs=4, rate=2.0, **options)


@query("ml03_epoch_losses", epochs_sql(4, 2.0, "{}"))
def ml03_epochs(spark, d):
    return G.epoch_rows(*trained(spark, d)).withColumn("loss", F.round("loss", 9))


@query("ml04_epoch_losses", epochs_sql(4, 2.0, "greatest(0.0::DOUBLE, {})"))
def ml04_epochs(spark, d):
    return G.epoch_rows(*trained(spark, d, non_negative=True)).withColumn("loss", F.round("loss", 9))


@query("ml05_batch_scoring", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64, 6) AS mean_score, round(CAST(list_max(embedding) AS DOUBLE), 6) AS max_score FROM embeddings")
def ml05(spark, d):
    scored = R.score_rows(B.vectors(spark, d), "vec_id", "embedding", {"mean_score": lambda m: m.mean(axis=1), "max_score": lambda m: np.max(m, axis=1)})
    return scored.select("vec_id", C.signed_round(F.col("mean_score"), 6).alias("mean_score"), C.signed_round(F.col("max_score"), 6).alias("max_score"))


@query("smp14_diverse_choice")
def smp14(spark, d):
    rows = B.vectors(spark, d).withColumn("score", (F.col("vec_id") * 7919 % 997) / F.lit(997.0))
    return R.diverse_choice(rows, "vec_id", "embedding", "score", 96, 8, 3)


@query("udf04_row_predicates", sql("SELECT 'short' AS predicate, count(*) FILTER (WHERE bytes < 500) AS n_rows FROM manifest_v UNION ALL SELECT 'fake', count(*) FILTER (WHERE label = 1) FROM manifest_v", "manifest_v"))
def udf04(spark, d):
    return J.count_by_predicate(B.manifest(spark, d), {"short": F.col("bytes") < 500, "fake": F.col("label") == 1})


@query("udf06_gate_spec", sql("WITH clean AS (SELECT * FROM predictions_v WHERE condition = 'clean'), a AS (WITH " + auc_sql("clean", [])[5:] + ") SELECT 'clean' AS check_name, auc AS observed, 0.5::DOUBLE AS bound, auc >= 0.5 AS passes FROM a", "predictions_v"))
def udf06(spark, d):
    gate = J.GateSpec(valid=lambda rows: rows.filter("score IS NULL"), metrics=lambda rows: M.auc(rows).select(F.col("auc").alias("clean")), rules=(("clean", "clean", ">=", None, 0.5),))
    return J.evaluate_gate(B.predictions(spark, d).filter("condition = 'clean'"), gate).select("check_name", "observed", "bound", "passes")


MIXTURE_SQL = f"""WITH f AS (SELECT sample_id, label, generator AS g, row_number() OVER (PARTITION BY generator ORDER BY {rank_sql(1, 'mix', 'sample_id')}) AS n FROM manifest_v WHERE label = 1), fk AS (SELECT * FROM f WHERE n <= 3), r AS (SELECT sample_id, label, real_source AS g, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(1, 'mix', 'sample_id')}) AS n FROM manifest_v WHERE label = 0)
SELECT sample_id, label FROM fk UNION ALL SELECT sample_id, label FROM r WHERE n <= (SELECT count(*) FROM fk)"""


@query("job01_base_mixture", sql(MIXTURE_SQL, "manifest_v"))
def job01(spark, d):
    return J.base_mixture(B.manifest(spark, d), 3, 1).select("sample_id", "label")


@query("job05_permissive_mixture", sql(f"""WITH ok AS (SELECT m.* FROM manifest_v m JOIN documents d ON m.sample_id = d.doc_id WHERE NOT contains(lower(d.text), 'license')), one AS (SELECT content_sha256, min(sample_id) AS sample_id FROM ok GROUP BY 1),
r AS (SELECT ok.sample_id, ok.label, row_number() OVER (PARTITION BY ok.label ORDER BY {rank_sql(12, 'permissive', 'ok.sample_id')}) AS n FROM ok JOIN one USING (sample_id)) SELECT sample_id, label, 'CC-BY-4.0' AS license_id FROM r WHERE n <= 40""", "manifest_v"))
def job05(spark, d):
    rows = B.manifest(spark, d).join(B.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text"), "sample_id")
    return J.permissive_mixture(rows, ["license"], 40, 12, "CC-BY-4.0").select("sample_id", "label", "license_id")


@query("job09_balanced_gate", sql(f"SELECT sample_id, label, real_source FROM (SELECT *, row_number() OVER (PARTITION BY label, coalesce(generator, real_source) ORDER BY {rank_sql(9, 'gate', 'sample_id')}) AS n FROM manifest_v) WHERE n <= 4", "manifest_v"))
def job09(spark, d):
    return J.balanced_gate(B.manifest(spark, d), 4, 9).select("sample_id", "label", "real_source")


@query("job16_matched_pairs")
def job16(spark, d):
    return J.matched_pairs(B.vectors(spark, d).withColumn("label", (F.col("label") >= 5).cast("int")), "vec_id", "embedding")


@query("job16_pair_properties", "SELECT CAST(2 * least(l, r) AS BIGINT) AS n_rows, CAST(least(l, r) AS BIGINT) AS n_pairs, CAST(2 * least(l, r) AS BIGINT) AS n_ids, TRUE AS one_of_each_label FROM (SELECT count(*) FILTER (label >= 5) AS l, count(*) FILTER (label < 5) AS r FROM embeddings)")
def job16_properties(spark, d):
    pairs = job16(spark, d).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("labels"), F.min("vec_id").alias("x"), F.max("vec_id").alias("y"))
    ids = pairs.select("*", F.explode(F.array("x", "y")).alias("id"))
    return ids.agg(F.sum(F.col("n") / 2).cast("long").alias("n_rows"), F.count_distinct("pair_id").alias("n_pairs"), F.count_distinct("id").alias("n_ids"), F.bool_and((F.size("labels") == 2) & (F.col("n") == 2)).alias("one_of_each_label"))


REPORT_TAIL = "SELECT condition, level, generator, real_source, auc FROM grp UNION ALL SELECT condition, 'worst_pair', NULL, NULL, min(auc) FROM grp WHERE level = 'pair' GROUP BY condition"


@query("job19_condition_matrix", sql(grouped_sql("predictions_v", ["condition"], REPORT_TAIL), "predictions_v"))
def job19(spark, d):
    """A run that ended after some conditions, and one that goes on where it stopped."""
    folder, own = W.fresh_folder(spark, "matrix"), W.signature(seed=7, source="manifest")
    rows, names = B.manifest(spark, d), list(B.CONDITIONS)
    scored = lambda todo: B.scored(rows, todo)
    W.write_condition(scored(names[:8]), folder, own)
    return J.resumed_matrix(spark, names, scored, folder, own)


#: Conditions that need no encoder, and the head that scores their pictures.
PICTURED = [n for n in B.CONDITIONS if not n.startswith("jpeg")]
HEAD, SLOPE = [[((7 * (4 * i + j)) % 16 - 7.5) / 16 for j in range(4)] for i in range(4)], 6.0

PICTURES = "px AS (SELECT vec_id, list_transform(embedding, lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * CAST(x AS DOUBLE)))) AS embedding FROM embeddings WHERE len(embedding) = 64)"


def pictures(spark, d):
    """Vectors as grey pictures of eight by eight, from [-1, 1] to [0, 1]."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.lit(0.5) * x.cast("double"))))
    return B.vectors(spark, d).filter(F.size("embedding") == 64).select("vec_id", grey.alias("embedding"))


def conditions_sql(value) -> str:
    """One SELECT for each condition: (vec_id, idx, condition, what ``value`` makes of its pixels and their side)."""
    side = lambda n: 6 if n == "center_crop_80" else 8
    return " UNION ALL ".join(f"SELECT vec_id, {i} AS idx, '{n}' AS condition, {value('p', side(n))} FROM (SELECT vec_id, {L.condition_sql(n, i, 'vec_id', 7)} AS p FROM px)" for i, n in enumerate(B.CONDITIONS) if n in PICTURED)


@query("krn05_pictures_by_condition", f"WITH {PICTURES} " + conditions_sql(lambda p, _: f"list_transform({p}, lambda x: round(x, 6)) AS pixels"))
def krn05_pictures(spark, d):
    """All pictures under all conditions but the encoder's, each read once."""
    made = N.each_condition(pictures(spark, d), "vec_id", "embedding", (8, 8, 1), B.CONDITIONS, PICTURED, 7)
    return made.withColumn("pixels", F.transform("pixels", lambda x: F.round(x, 6)))


PICTURE_SCORES = f"{PICTURES}, made AS ({conditions_sql(lambda p, side: f'round({L.score_sql(p, side, HEAD, SLOPE)}, 6) AS score')}), scored AS (SELECT condition, label, generator, real_source, sample_id, score FROM made JOIN manifest_v ON sample_id = vec_id), "


@query("job19_picture_matrix", sql("WITH " + PICTURE_SCORES + grouped_sql("scored", ["condition"], REPORT_TAIL)[5:], "manifest_v"))
def job19_pictures(spark, d):
    """The matrix of scores of real pixels: a run that ended after some conditions, and one that goes on where it stopped."""
    folder, own = W.fresh_folder(spark, "pictures"), W.signature(seed=7, source="pictures", head=str(HEAD))
    named, head = B.manifest(spark, d).select("label", "generator", "real_source", "sample_id"), N.linear_score(np.array(HEAD), SLOPE)

    def scored(todo):
        found = N.each_condition(pictures(spark, d), "vec_id", "embedding", (8, 8, 1), B.CONDITIONS, todo, 7, head)
        return found.join(named, F.col("vec_id") == F.col("sample_id")).select("condition", "label", "generator", "real_source", "sample_id", F.round("score", 6).alias("score"))

    W.write_condition(scored(PICTURED[:5]), folder, own)
    return J.resumed_matrix(spark, PICTURED, scored, folder, own)


@query("job20_blend_matrix", sql("WITH b AS (SELECT condition, label, 0.5 * score + 0.5 * score_b AS score FROM predictions2_v), " + auc_sql("b", ["condition"])[5:], "predictions2_v"))
def job20(spark, d):
    return J.blend_matrix(B.predictions2(spark, d), "score", "score_b", 0.5)


@query("job21_matched_subset_scores", sql(f"""WITH q AS (SELECT format, size_bucket, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS quota FROM meta_v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY format, size_bucket, label ORDER BY {rank_sql(6, 'strata', 'sample_id')}) AS place FROM meta_v),
s AS (SELECT r.sample_id FROM r JOIN q USING (format, size_bucket) WHERE place <= quota), sub AS (SELECT * FROM predictions_v WHERE sample_id IN (SELECT sample_id FROM s)), """ + auc_sql("sub", ["condition"])[5:], "meta_v", "predictions_v"))
def job21(spark, d):
    return J.matched_subset_scores(B.meta(spark, d), B.predictions(spark, d), ["format", "size_bucket"], 6)
