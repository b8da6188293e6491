"""Further queries: contracts and joins of particular gates, weights, remaining decisions, and composed jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import contracts as K
from evalmill.operators import curate as U
from evalmill.operators import decide as D
from evalmill.operators import errors as E
from evalmill.operators import metrics as M
from evalmill.operators import neighbours as N
from evalmill.operators import sample as S
from evalmill.operators import score as R
from evalmill.operators import stats as T
from evalmill.plans import bindings as B
from evalmill.plans import jobs as J
from evalmill.plans import kernel_sql as L
from evalmill.plans.bindings import sql
from evalmill.plans.curate_queries import HASHES, METRIC_NAMES, METRICS_SQL, hashes, metric_rows, side_by_side, similar
from evalmill.plans.metric_queries import NOISE, auc_sql, grouped_sql, paired
from evalmill.plans.registry import query
from evalmill.plans.stat_queries import BLOCK, GROUP, group, rank_sql, tree_sql

RULE_SQL = "SELECT CAST(sample_id AS VARCHAR) AS row_key, rule FROM (SELECT sample_id, unnest([{cases}]) AS rule FROM {view}) WHERE rule IS NOT NULL"


def rule_sql(view: str, **conditions: str) -> str:
    return RULE_SQL.format(cases=", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in conditions.items()), view=view)


@query("con04_null_tolerant_contract", sql("WITH v AS (SELECT *, CASE WHEN sample_id % 4 = 0 THEN NULL ELSE sample_id % 4 = 1 END AS training_allowed FROM manifest_v) " + rule_sql("v", not_training="training_allowed IS NULL OR NOT training_allowed", terms="NOT contains(path, 'src7')"), "manifest_v"))
def con04(spark, d):
    allowed = F.when(F.col("sample_id") % 4 != 0, F.col("sample_id") % 4 == 1)
    rows = B.manifest(spark, d).withColumn("training_allowed", allowed)
    return K.violations(rows, "sample_id", {"not_training": ~F.col("training_allowed").eqNullSafe(True), "terms": ~C.has_forbidden_term(F.col("path"), ["src7"])})


@query("con05_file_digests", sql("SELECT sample_id, content_sha256 = sha256(d.text) AS same_digest, bytes = length(d.text) AS same_size FROM manifest_v JOIN documents d ON d.doc_id = sample_id", "manifest_v"))
def con05(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return B.manifest(spark, d).join(docs, "sample_id").select("sample_id", (F.col("content_sha256") == F.sha2("text", 256)).alias("same_digest"), (F.col("bytes") == F.length("text")).alias("same_size"))


@query("con07_block_composition", sql(f"SELECT block, label, count(*) AS n_rows, count(DISTINCT content_sha256) = count(*) AS unique_content FROM (SELECT *, {BLOCK} AS block FROM manifest_v) GROUP BY 1, 2", "manifest_v"))
def con07(spark, d):
    rows = B.manifest(spark, d).withColumn("block", F.when(F.col("sample_id") % 5 == 0, "frontier").otherwise("legacy"))
    return rows.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("content_sha256") == F.count(F.lit(1))).alias("unique_content"))


@query("con09_frontier_rows", sql("" + rule_sql("quality_v", only_fakes="label = 1", generator="starts_with(generator, 'src1')"), "quality_v"))
def con09(spark, d):
    return K.violations(B.quality(spark, d), "sample_id", {"only_fakes": F.col("label") == 1, "generator": F.col("generator").startswith("src1")})


@query("con10_table_verification", sql("SELECT coalesce(m.content_sha256, d.h) AS digest, CASE WHEN m.content_sha256 IS NULL THEN 'unlisted' WHEN d.h IS NULL THEN 'missing' WHEN m.bytes <> d.bytes THEN 'size' ELSE 'ok' END AS state FROM (SELECT content_sha256, min(bytes) AS bytes FROM manifest_v GROUP BY 1) m FULL JOIN (SELECT sha256(text) AS h, min(n_chars) AS bytes FROM documents GROUP BY 1) d ON m.content_sha256 = d.h", "manifest_v"))
def con10(spark, d):
    listed = B.manifest(spark, d).groupBy("content_sha256").agg(F.min("bytes").alias("bytes"))
    there = B.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.min("n_chars").alias("found"))
    state = F.when(F.col("bytes").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("bytes") != F.col("found"), "size").otherwise("ok")
    return listed.join(there, "content_sha256", "full").select(F.col("content_sha256").alias("digest"), state.alias("state"))


@query("con11_source_pins", "SELECT source, n_lines AS n_rows, n_bytes, digest FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY source) JOIN (" + tree_sql("SELECT source, CAST(doc_id AS VARCHAR) AS line FROM documents", "source") + ") USING (source)")
def con11(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    pins = T.inventory_digest(docs, F.col("doc_id").cast("string"), ["source"])
    return docs.groupBy("source").agg(F.sum("n_chars").alias("n_bytes")).join(pins, "source").select("source", F.col("n_lines").alias("n_rows"), "n_bytes", "digest")


@query("jn05_manifest_driven_blend", sql("SELECT m.sample_id, m.label, 0.9 * a.score + 0.1::DOUBLE * b.score_b AS score, a.label = m.label AND b.label = m.label AS labels_agree FROM manifest_v m LEFT JOIN (SELECT * FROM predictions2_v WHERE condition = 'clean') a ON a.sample_id = m.sample_id LEFT JOIN (SELECT * FROM predictions2_v WHERE condition = 'clean') b ON b.sample_id = m.sample_id", "manifest_v", "predictions2_v"))
def jn05(spark, d):
    clean = B.predictions2(spark, d).filter("condition = 'clean'")
    side = lambda c, n: clean.select("sample_id", F.col(c).alias(n), F.col("label").alias(f"label_{n}"))
    joined = B.manifest(spark, d).join(side("score", "a"), "sample_id", "left").join(side("score_b", "b"), "sample_id", "left")
    return joined.select("sample_id", "label", (0.9 * F.col("a") + 0.1 * F.col("b")).alias("score"), ((F.col("label_a") == F.col("label")) & (F.col("label_b") == F.col("label"))).alias("labels_agree"))


@query("jn10_identity_separation", sql("SELECT role, identity, count(*) AS n_rows FROM (SELECT s.role, 'content_sha256' AS identity FROM split_v s WHERE content_sha256 IN (SELECT content_sha256 FROM quality_v WHERE label = 1) UNION ALL SELECT s.role, 'path' FROM split_v s WHERE path IN (SELECT path FROM quality_v WHERE label = 1)) GROUP BY 1, 2", "split_v", "quality_v"))
def jn10(spark, d):
    gate = B.quality(spark, d).filter("label = 1")
    parts = [B.split(spark, d).join(gate.select(c).distinct(), c, "left_semi").groupBy("role").agg(F.lit(c).alias("identity"), F.count(F.lit(1)).alias("n_rows")) for c in ("content_sha256", "path")]
    return parts[0].unionByName(parts[1]).select("role", "identity", "n_rows")


@query("jn25_pair_self_join", sql("SELECT f.pair_id, f.sample_id AS fake_id, r.sample_id AS real_id FROM pair_v f JOIN pair_v r ON f.pair_id = r.pair_id AND f.label = 1 AND r.label = 0", "pair_v"))
def jn25(spark, d):
    side = lambda v: F.max(F.when(F.col("label") == v, F.col("sample_id")))
    return B.pairs(spark, d).groupBy("pair_id").agg(side(1).alias("fake_id"), side(0).alias("real_id"))


@query("agg26_gate_sides", sql(grouped_sql("predictions_v", ["condition"], "SELECT condition, real_source, auc, place FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY auc, real_source) AS place FROM grp WHERE level = 'source') WHERE place <= 10"), "predictions_v"))
def agg26(spark, d):
    sides = M.grouped_auc(B.predictions(spark, d), ["condition"]).filter("level = 'source'").select("condition", "real_source", "auc")
    return E.lowest(sides, ["condition"], "auc", 10, "real_source")


@query("agg26_gate_summary", sql(grouped_sql("predictions_v", ["condition"], """SELECT condition, level, group_name, auc, side, place, mean_auc FROM (SELECT condition, level, coalesce(generator, real_source) AS group_name, auc, avg(auc) OVER (PARTITION BY condition, level) AS mean_auc,
row_number() OVER (PARTITION BY condition, level ORDER BY auc, coalesce(generator, real_source)) AS low, row_number() OVER (PARTITION BY condition, level ORDER BY auc DESC, coalesce(generator, real_source)) AS high FROM grp WHERE level IN ('source', 'generator')), LATERAL (VALUES ('bottom', low), ('top', high)) s(side, place) WHERE place <= 10"""), "predictions_v"))
def agg26_summary(spark, d):
    sides = M.grouped_auc(B.predictions(spark, d), ["condition"]).filter("level IN ('source', 'generator')")
    return E.ranked_sides(sides.select("condition", "level", F.coalesce("generator", "real_source").alias("group_name"), "auc"), ["condition", "level"], "auc", 10, "group_name")


@query("agg26_gate_identity", sql("SELECT count(*) AS n_rows, count(DISTINCT content_sha256) AS n_contents, count(*) = count(DISTINCT content_sha256) AS unique_contents, count(*) FILTER (WHERE content_sha256 IN (SELECT content_sha256 FROM split_v WHERE role = 'train')) AS n_shared, count(*) FILTER (WHERE content_sha256 IN (SELECT content_sha256 FROM split_v WHERE role = 'train')) = 0 AS disjoint FROM split_v WHERE role = 'eval'", "split_v"))
def agg26_identity(spark, d):
    rows = B.split(spark, d)
    return U.gate_identity(rows.filter("role = 'eval'"), rows.filter("role = 'train'"), "content_sha256")


@query("top02_compact_lists", sql("SELECT condition, label, sample_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY condition, label ORDER BY CASE WHEN label = 0 THEN -score ELSE score END, path) AS place FROM predictions_v) WHERE place <= 5", "predictions_v"))
def top02(spark, d):
    order = Window.partitionBy("condition", "label").orderBy(F.when(F.col("label") == 0, -F.col("score")).otherwise(F.col("score")), "path")
    return B.predictions(spark, d).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("condition", "label", "sample_id", "score", "place")


@query("set02_distinct_contents", sql("SELECT content_sha256, count(*) AS n_rows, min(sample_id) AS first_id FROM manifest_v GROUP BY 1 HAVING count(*) > 1", "manifest_v"))
def set02(spark, d):
    return B.manifest(spark, d).groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n_rows"), F.min("sample_id").alias("first_id")).filter("n_rows > 1")


@query("smp06_named_sample", sql("SELECT sample_id, name FROM (SELECT sample_id, 'a' AS name, row_number() OVER (ORDER BY " + rank_sql(2, "a", "sample_id") + ") AS n FROM manifest_v UNION ALL SELECT sample_id, 'b', row_number() OVER (ORDER BY " + rank_sql(2, "b", "sample_id") + ") FROM manifest_v) WHERE n <= 12", "manifest_v"))
def smp06(spark, d):
    rows = B.manifest(spark, d)
    part = lambda name: S.global_top(rows, 12, S.rank_of(2, name, "sample_id")).select("sample_id", F.lit(name).alias("name"))
    return part("a").unionByName(part("b"))


@query("smp13_ranked_slices", sql("SELECT sample_id, CASE WHEN place <= 50 THEN 'first' ELSE 'second' END AS slice FROM (SELECT sample_id, row_number() OVER (ORDER BY content_sha256, sample_id) AS place FROM manifest_v) WHERE place <= 60", "manifest_v"))
def smp13(spark, d):
    ranked = B.manifest(spark, d).select("sample_id", "content_sha256").orderBy("content_sha256", "sample_id").limit(60)
    place = F.row_number().over(Window.orderBy("content_sha256", "sample_id"))  # sixty rows
    return ranked.withColumn("place", place).select("sample_id", F.when(F.col("place") <= 50, "first").otherwise("second").alias("slice"))


@query("smp16_dataset_mass", sql("WITH t AS (SELECT sample_id, label, left(path, 9) AS dataset FROM manifest_v), n AS (SELECT dataset, label, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM n GROUP BY 1) SELECT sample_id, 0.5 / CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS weight FROM t JOIN n USING (dataset, label) JOIN k USING (label)", "manifest_v"))
def smp16(spark, d):
    rows = B.manifest(spark, d).select("sample_id", "label", F.substring("path", 1, 9).alias("dataset"))
    sizes = rows.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("label")))
    return rows.join(sizes, ["dataset", "label"]).select("sample_id", (0.5 / F.col("k").cast("double") / F.col("n").cast("double")).alias("weight"))


LOW_BLOCK = "CASE WHEN bytes < 600 AND sample_id % 2 = 0 THEN 'paired' WHEN bytes < 600 THEN 'low' ELSE 'rest' END"


@query("smp18_low_resolution_blocks", sql(f"WITH t AS (SELECT sample_id, label, {LOW_BLOCK} AS block, {GROUP} AS g FROM manifest_v), s AS (SELECT block, label, g, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT block, label, count(*) AS k FROM s GROUP BY ALL) SELECT sample_id, t.block, 0.5 * CASE t.block WHEN 'paired' THEN 0.25 WHEN 'low' THEN 0.15 ELSE 0.60 END / CAST(k * n AS DOUBLE) AS weight FROM t JOIN s USING (block, label, g) JOIN k USING (block, label)", "manifest_v"))
def smp18(spark, d):
    low = F.col("bytes") < 600
    block = F.when(low & (F.col("sample_id") % 2 == 0), "paired").when(low, "low").otherwise("rest")
    return S.block_weights(B.manifest(spark, d), block, group(), {"paired": 0.25, "low": 0.15, "rest": 0.60}).select("sample_id", "block", "weight")


@query("krn03_popcount", f"WITH {HASHES} SELECT vec_id, CAST(bit_count(dh) AS BIGINT) AS n_bits FROM hash_v")
def krn03(spark, d):
    return hashes(spark, d).select("vec_id", F.bit_count("dh").cast("long").alias("n_bits"))


@query("krn10_blur", f"SELECT vec_id, {L.linear_sql(L.blur_weights(8, 1.0), L.blur_weights(8, 1.0))} AS blurred FROM embeddings")
def krn10(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (8, 8), "blur_1").select("vec_id", F.transform("embedding", lambda x: C.signed_round(x, 9)).alias("blurred"))


@query("krn12_preprocess", f"SELECT vec_id, {L.linear_sql(L.resize_weights(4, 8), L.resize_weights(4, 8), '(({}) - 0.5) / 0.5')} AS pixels FROM embeddings")
def krn12(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (8, 8), "evaluation_crop").select("vec_id", F.transform("embedding", lambda x: C.signed_round(x, 9)).alias("pixels"))


@query("krn13_canonical_square", f"SELECT vec_id, {L.linear_sql(L.window(0, 4, 4), L.window(6, 4, 16))} AS pixels FROM embeddings")
def krn13(spark, d):
    return R.apply_kernel(B.vectors(spark, d), "vec_id", "embedding", (4, 16), "canonical_4").select("vec_id", F.transform("embedding", lambda x: C.signed_round(x, 9)).alias("pixels"))


@query("ml07_paired_scoring", "WITH s AS (SELECT vec_id, label, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) AS a, list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))) AS b FROM embeddings) SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(0.5 * a + 0.5 * b, 6) AS blend FROM s")
def ml07(spark, d):
    both = R.score_rows(B.vectors(spark, d), "vec_id", "embedding", {"a": lambda m: m[:, :32].sum(axis=1), "b": lambda m: m[:, 32:].sum(axis=1)})
    return both.select("vec_id", C.signed_round(F.col("a"), 6).alias("a"), C.signed_round(F.col("b"), 6).alias("b"), C.signed_round(C.blend(F.col("a"), F.col("b"), 0.5), 6).alias("blend"))


@query("udf02_group_callables", sql(grouped_sql("meta_s", ["condition"], "SELECT * FROM grp", "score", "mode", "format").replace("WITH reals", "WITH meta_s AS (SELECT p.condition, p.label, p.score, m.mode, m.format FROM predictions_v p JOIN meta_v m ON p.sample_id = m.sample_id), reals", 1), "predictions_v", "meta_v"))
def udf02(spark, d):
    meta = B.meta(spark, d).select("sample_id", "mode", "format")
    rows = B.predictions(spark, d).join(meta, "sample_id")
    return M.grouped_auc(rows, ["condition"], "mode", "format").withColumnsRenamed({"mode": "generator", "format": "real_source"})


# Decisions on further metrics of both candidates.
EXTRA_SQL = METRICS_SQL + f""", content AS (SELECT candidate, max(auc) FILTER (WHERE condition = 'jpeg_q90') AS content_clean, round(0.5 * (max(auc) FILTER (WHERE condition = 'clean') + avg(auc) FILTER (WHERE condition <> 'clean')), 9) AS selected_official FROM by_condition GROUP BY 1),
cpair_v AS (SELECT * FROM both_v WHERE condition = 'jpeg_q90'), cgrp AS ({grouped_sql("cpair_v", ["candidate"], "SELECT * FROM grp", "value")}), cpair AS (SELECT candidate, min(auc) AS content_pair FROM cgrp WHERE level = 'pair' GROUP BY 1),
deltas AS (SELECT min(a.auc - b.auc) AS lowest_delta, min(a.auc - b.auc) FILTER (WHERE a.condition <> 'clean') AS lowest_stress_delta FROM by_condition a JOIN by_condition b ON a.condition = b.condition AND a.candidate = 'score' AND b.candidate = 'score_b'),
routes AS (SELECT count(*) FILTER (WHERE condition = 'clean' AND noise >= 0.055) / CAST(count(*) FILTER (WHERE condition = 'clean') AS DOUBLE) AS clean_route_rate, count(*) FILTER (WHERE condition = 'noise_sigma_0.10' AND noise >= 0.055) / CAST(count(*) FILTER (WHERE condition = 'noise_sigma_0.10') AS DOUBLE) AS noise_route_rate FROM (SELECT *, {NOISE} AS noise FROM predictions2_v)),
prs_m AS (SELECT q.pair_id, p.label, p.score, p.generator FROM predictions2_v p JOIN pair_v q ON p.sample_id = q.sample_id WHERE p.condition = 'clean'), flat_p AS (SELECT pair_id, max(score) FILTER (WHERE label = 1) AS fake, max(score) FILTER (WHERE label = 0) AS real, max(generator) AS pg FROM prs_m GROUP BY 1),
pa AS (SELECT CAST(sum(CASE WHEN fake > real THEN 2 WHEN fake = real THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*)) AS paired_accuracy FROM flat_p), prompt_v AS (SELECT s.label, s.score, f.pg FROM prs_m s JOIN flat_p f USING (pair_id)), prompts AS (WITH {auc_sql("prompt_v", ["pg"])[5:]}), wp AS (SELECT min(auc) AS worst_prompt FROM prompts),
mm AS (SELECT m.*, clean AS selection_clean, worst_pair AS selection_pair, content_clean, selected_official, content_pair FROM m JOIN content USING (candidate) JOIN cpair USING (candidate))
"""
EXTRA_NAMES = (*METRIC_NAMES, "selection_clean", "selection_pair", "content_clean", "content_pair", "selected_official")
SINGLE = ("lowest_delta", "lowest_stress_delta", "clean_route_rate", "noise_route_rate", "paired_accuracy", "worst_prompt")


def wide_metrics(spark, d):
    """All metrics of ``score``, those of ``score_b`` as other_*, and those of the pair of them."""
    both = M.unpivot_scores(M.pooled(B.predictions2(spark, d)), ["score", "score_b"])
    by = M.auc(both, ["candidate", "condition"])
    content = by.groupBy("candidate").agg(F.max(F.when(F.col("condition") == "jpeg_q90", F.col("auc"))).alias("content_clean"), F.round(0.5 * (F.max(F.when(F.col("condition") == "clean", F.col("auc"))) + F.avg(F.when(F.col("condition") != "clean", F.col("auc")))), 9).alias("selected_official"))
    cpair = M.grouped_auc(both.filter("condition = 'jpeg_q90'"), ["candidate"]).filter("level = 'pair'").groupBy("candidate").agg(F.min("auc").alias("content_pair"))
    rows = metric_rows(spark, d).join(content, "candidate").join(cpair, "candidate").withColumn("selection_clean", F.col("clean")).withColumn("selection_pair", F.col("worst_pair"))
    a, b = by.filter("candidate = 'score'").alias("a"), by.filter("candidate = 'score_b'").alias("b")
    delta = F.col("a.auc") - F.col("b.auc")
    deltas = a.join(b, F.col("a.condition") == F.col("b.condition")).agg(F.min(delta).alias("lowest_delta"), F.min(F.when(F.col("a.condition") != "clean", delta)).alias("lowest_stress_delta"))
    noise = (F.col("sample_id") * 31 + F.col("idx") * 17) % 100 / F.lit(1000.0) >= 0.055
    rate = lambda c: F.count_if((F.col("condition") == c) & noise) / F.count_if(F.col("condition") == c).cast("double")
    routes = B.predictions2(spark, d).agg(rate("clean").alias("clean_route_rate"), rate("noise_sigma_0.10").alias("noise_route_rate"))
    pairs = paired(spark, d).filter("condition = 'clean'").select("pair_id", "label", "score", "generator")
    tag = pairs.filter("label = 1").select("pair_id", F.col("generator").alias("pg"))
    accuracy = M.paired_accuracy(pairs).select("paired_accuracy")
    prompt = M.auc(pairs.join(tag, "pair_id"), ["pg"]).agg(F.min("auc").alias("worst_prompt"))
    out = side_by_side(rows, EXTRA_NAMES)
    for single in (deltas, routes, accuracy, prompt):  # one row each
        out = out.crossJoin(F.broadcast(single))
    return out


def extra_sql(rules) -> str:
    start = EXTRA_SQL + ", c AS (SELECT a.*, " + ", ".join(f"b.{n} AS other_{n}" for n in EXTRA_NAMES) + ", deltas.*, routes.*, pa.*, wp.* FROM mm a CROSS JOIN mm b CROSS JOIN deltas CROSS JOIN routes CROSS JOIN pa CROSS JOIN wp WHERE a.candidate = 'score' AND b.candidate = 'score_b')\n"
    parts = []
    for name, left, op, right, number in rules:
        bound = f"{right or '0.0::DOUBLE'} + ({number})::DOUBLE"
        parts.append(f"SELECT candidate, '{name}' AS check_name, {left} AS observed, {bound} AS bound, coalesce({left} {op} {bound}, false) AS passes FROM c")
    return sql(start + "\nUNION ALL ".join(parts), "predictions2_v", "pair_v")


def _rule_query(number: str, name: str):
    @query(f"dec{number}_{name}", extra_sql(D.RULES[name]))
    def run(spark, d):
        return D.decide(wide_metrics(spark, d), ["candidate"], D.RULES[name])

    return run


for _number, _name in (("03", "semantic"), ("07", "repair"), ("08", "routing_screen"), ("09", "routing_promotion"), ("10", "view_policy"), ("11", "flip_policy")):
    _rule_query(_number, _name)


@query("job03_mixture_with_holdouts", sql(f"WITH h AS (SELECT min(generator) AS g FROM manifest_v WHERE label = 1), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(3, 'holdout', 'sample_id')}) AS n FROM manifest_v WHERE generator IS NULL OR generator <> (SELECT g FROM h)) SELECT sample_id, label, 'train' AS role FROM t WHERE n <= 20 UNION ALL SELECT sample_id, label, 'holdout' FROM manifest_v WHERE generator = (SELECT g FROM h)", "manifest_v"))
def job03(spark, d):
    return J.mixture_with_holdout(B.manifest(spark, d), 20, 3).select("sample_id", "label", "role")


@query("job04_disjoint_breadth", sql("SELECT sample_id, generator FROM split_v WHERE role = 'eval' AND label = 1 AND generator NOT IN (SELECT generator FROM split_v WHERE role = 'train' AND label = 1)", "split_v"))
def job04(spark, d):
    rows = B.split(spark, d).filter("label = 1")
    return rows.filter("role = 'eval'").join(rows.filter("role = 'train'").select("generator"), "generator", "left_anti").select("sample_id", "generator")


@query("job07_cross_source_gates", sql(f"SELECT sample_id, label, gate FROM (SELECT m.sample_id, m.label, g.gate, row_number() OVER (PARTITION BY g.gate, m.label ORDER BY sha256(concat_ws(':', '7', g.gate, CAST(m.sample_id AS VARCHAR)))) AS n FROM manifest_v m JOIN (SELECT DISTINCT real_source AS gate FROM manifest_v WHERE label = 0) g ON m.label = 1 OR m.real_source = g.gate) WHERE n <= 6", "manifest_v"))
def job07(spark, d):
    return J.cross_source_gates(B.manifest(spark, d), 6, 7).select("sample_id", "label", "gate")


@query("job08_content_holdout", sql(f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {rank_sql(8, 'holdout', 'sample_id')}) AS n FROM split_v WHERE role = 'eval' AND content_sha256 NOT IN (SELECT content_sha256 FROM split_v WHERE role = 'train')) SELECT sample_id, label FROM f WHERE n <= 15", "split_v"))
def job08(spark, d):
    rows = B.split(spark, d)
    fresh = rows.filter("role = 'eval'").join(rows.filter("role = 'train'").select("content_sha256"), "content_sha256", "left_anti").withColumn("group_name", group())
    return S.lowest_ranked(fresh, ["group_name"], 15, S.rank_of(8, "holdout", "sample_id")).select("sample_id", "label")


@query("job13_fresh_matched_gate", sql("WITH used AS (SELECT content_sha256 FROM split_v WHERE role = 'train'), one AS (SELECT content_sha256, label, min(sample_id) AS sample_id FROM split_v WHERE role = 'eval' AND content_sha256 NOT IN (SELECT content_sha256 FROM used) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY content_sha256) AS n FROM one), k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM one GROUP BY label)) SELECT sample_id, label, n AS place FROM r CROSS JOIN k WHERE n <= k", "split_v"))
def job13(spark, d):
    rows = B.split(spark, d)
    return J.fresh_matched_gate(rows.filter("role = 'eval'"), rows.filter("role = 'train'")).select("sample_id", "label", "place")


@query("job17_matchable_prompts")
def job17(spark, d):
    found = N.top_summary(similar(spark, d, 8), "vec_id").withColumn("score", F.col("mean_similarity"))
    rows = B.vectors(spark, d).join(found, "vec_id").select("vec_id", "embedding", "score")
    return R.diverse_choice(rows, "vec_id", "embedding", "score", 96, 8, 5)


@query("job18_generator_disjoint_split", sql("SELECT sample_id, CASE WHEN label = 1 THEN CASE WHEN substr(sha256(generator), 1, 1) < '8' THEN 'train' ELSE 'eval' END ELSE CASE WHEN substr(sha256(CAST(sample_id AS VARCHAR)), 1, 1) < '8' THEN 'train' ELSE 'eval' END END AS part FROM manifest_v", "manifest_v"))
def job18(spark, d):
    key = F.when(F.col("label") == 1, F.col("generator")).otherwise(F.col("sample_id").cast("string"))
    return B.manifest(spark, d).select("sample_id", F.when(F.substring(F.sha2(key, 256), 1, 1) < "8", "train").otherwise("eval").alias("part"))


@query("job22_failure_audit", sql("WITH a AS (WITH " + auc_sql("predictions_v", ["idx", "condition"])[5:] + "), c AS (SELECT auc AS clean FROM a WHERE condition = 'clean') SELECT condition, auc, round(auc - clean, 9) AS change, row_number() OVER (ORDER BY auc, idx) AS place FROM a CROSS JOIN c", "predictions_v"))
def job22(spark, d):
    by = M.auc(B.predictions(spark, d), ["idx", "condition"])
    clean = by.filter("condition = 'clean'").select(F.col("auc").alias("clean"))
    rows = E.lowest(by.crossJoin(F.broadcast(clean)), [], "auc", None, "idx")
    return rows.select("condition", "auc", F.round(F.col("auc") - F.col("clean"), 9).alias("change"), "place")


STRESS = f"""WITH o AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, embedding, CAST(floor((CAST(('0x' || substr({rank_sql(5, 'patch', 'vec_id')}, 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE) * 49) AS BIGINT) AS o FROM embeddings),
x AS (SELECT label, 'whole' AS condition, embedding AS v FROM o UNION ALL SELECT label, 'patch', embedding[o + 1 : o + 16] FROM o UNION ALL SELECT label, 'crop', embedding[17:48] FROM o),
stress AS (SELECT label, condition, round((list_sum(list_transform(v, lambda a: CAST(a AS DOUBLE))) / len(v) + 1) / 2, 9) AS score FROM x), """


@query("job23_shape_stress", STRESS + auc_sql("stress", ["condition"])[5:])
def job23(spark, d):
    rows = B.vectors(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    views = {"whole": F.col("embedding"), "patch": C.hashed_patch(F.col("embedding"), 16, 5, F.col("vec_id")), "crop": C.centre_crop(F.col("embedding"), 0.5)}
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)
    cells = F.array(*[F.struct(F.lit(n).alias("condition"), F.round((mean(v) + 1) / 2, 9).alias("score")) for n, v in views.items()])
    return M.auc(rows.select("label", F.explode(cells).alias("c")).select("label", "c.condition", "c.score"), ["condition"])


@query("agg22_source_dependence", sql("SELECT real_source, count(*) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std FROM predictions_v WHERE label = 0 AND condition = 'clean' GROUP BY 1", "predictions_v"))
def agg22b(spark, d):
    rows = T.distribution(B.predictions(spark, d).filter("label = 0 AND condition = 'clean'"), ["real_source"], "score")
    return rows.select("real_source", "n", "mean", "std")


@query("jn09b_removed_report", sql("SELECT label, count(*) AS n_rows FROM split_v WHERE role = 'eval' AND content_sha256 IN (SELECT content_sha256 FROM split_v WHERE role = 'train') GROUP BY 1", "split_v"))
def jn09b(spark, d):
    rows = B.split(spark, d)
    held = rows.filter("role = 'eval'")
    kept = U.without_shared_identity(held, rows.filter("role = 'train'").drop("sample_id"), "sample_id", ["content_sha256"])
    return held.join(kept.select("sample_id"), "sample_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ml06_cluster_properties", "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_clusters, TRUE AS nearest FROM embeddings")
def ml06_properties(spark, d):
    return R.cluster_properties(B.vectors(spark, d), "vec_id", "embedding", 8, 5)


CHOICE = "SELECT CAST(8 AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_ids, CAST(8 AS BIGINT) AS n_clusters, TRUE AS in_shortlist, TRUE AS has_best"


def choice_properties(chosen, rows, shortlist):
    """Of rows chosen for variety: how many, all of the shortlist, and with its best row, which no cluster can beat."""
    best = rows.orderBy(F.desc("score"), "vec_id").limit(shortlist).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))).select("vec_id", "place")
    met = chosen.join(F.broadcast(best), "vec_id", "left")
    return met.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.count_distinct("cluster").alias("n_clusters"), F.bool_and(F.col("place").isNotNull()).alias("in_shortlist"), F.bool_or(F.coalesce(F.col("place") == 1, F.lit(False))).alias("has_best"))


@query("smp14_choice_properties", CHOICE)
def smp14_properties(spark, d):
    rows = B.vectors(spark, d).withColumn("score", (F.col("vec_id") * 7919 % 997) / F.lit(997.0))
    return choice_properties(R.diverse_choice(rows, "vec_id", "embedding", "score", 96, 8, 3), rows, 96)


@query("job17_choice_properties", CHOICE)
def job17_properties(spark, d):
    found = N.top_summary(similar(spark, d, 8), "vec_id").select("vec_id", F.col("mean_similarity").alias("score"))
    return choice_properties(job17(spark, d), found, 96)


@query("job06_canonical_groups", f"WITH c AS (SELECT vec_id, label, {L.linear_sql(L.resize_weights(4, 8), L.resize_weights(4, 8), digits=6)} AS square FROM embeddings), g AS (SELECT square, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM c GROUP BY square) SELECT vec_id, n_rows, n_labels FROM c JOIN g USING (square)")
def job06_groups(spark, d):
    """How many rows and labels share each row's canonical square."""
    return J.canonical_view(B.vectors(spark, d), "vec_id", "embedding", (8, 8)).select("vec_id", "n_rows", "n_labels")


@query("ml01_probe_counts", sql("SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, TRUE AS is_share FROM meta_v WHERE sample_id % 2 = 1", "meta_v"))
def ml01_counts(spark, d):
    rows = B.meta(spark, d).withColumn("log_bytes", F.log1p("bytes")).withColumn("log_text", F.log1p("n_text")).select("sample_id", "label", "log_bytes", "log_text", "format", "mode")
    scored = R.shortcut_probe(rows.filter("sample_id % 2 = 0"), rows.filter("sample_id % 2 = 1"), ["log_bytes", "log_text"], ["format", "mode"], "sample_id")
    return M.auc(scored).select("n_pos", "n_neg", F.col("auc").between(0, 1).alias("is_share"))
