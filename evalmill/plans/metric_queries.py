"""Queries of the AUC family, of blends and of decisions' inputs, over the predictions views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import metrics as M
from evalmill.plans import bindings as B
from evalmill.plans.bindings import sql
from evalmill.plans.registry import query

#: SQL for the AUC of (view, keys, score): cells, running counts, one division.
def auc_sql(view: str, keys: list[str], score: str = "score", where: str = "TRUE") -> str:
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""WITH cells AS (SELECT {by}{score} AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {view} WHERE {where} GROUP BY {by}{score}),
le AS (SELECT *, sum(n) OVER ({part}ORDER BY s) AS le FROM cells)
SELECT {by}CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
  CASE WHEN sum(p) * sum(n) > 0 THEN CAST(sum(p * (2 * (le - n) + n)) AS DOUBLE) / (2 * CAST(sum(p) * sum(n) AS DOUBLE)) END AS auc FROM le {group}"""


POOLED_SQL = "pooled AS (SELECT *, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'pooled' END AS view FROM predictions2_v)"


def pooled_auc_sql(keys: list[str], score: str = "score") -> str:
    return "WITH " + POOLED_SQL + ", " + auc_sql("pooled", keys, score)[5:]


WINS_SQL = """WITH reals AS (SELECT {k}{r} AS r, {s} AS s, count(*) AS n FROM {v} WHERE label = 0 GROUP BY ALL),
fakes AS (SELECT {k}{f} AS f, {s} AS s, count(*) AS p FROM {v} WHERE label = 1 GROUP BY ALL),
srcs AS (SELECT DISTINCT {k}r FROM reals),
u AS (SELECT {k}r, s, n, NULL AS f, 0 AS p FROM reals UNION ALL SELECT {fk}q.r, fakes.s, 0, fakes.f, fakes.p FROM fakes JOIN srcs q ON {on}),
w AS (SELECT *, sum(n) OVER (PARTITION BY {k}r ORDER BY s) AS le, sum(n) OVER (PARTITION BY {k}r, s) AS eq, sum(n) OVER (PARTITION BY {k}r) AS tot FROM u),
prs AS (SELECT {k}f, r, sum(p * (2 * (le - eq) + eq)) AS wins2, sum(p * tot) AS pn FROM w WHERE f IS NOT NULL GROUP BY ALL),
grp AS (SELECT {k}CASE WHEN grouping(f) + grouping(r) = 0 THEN 'pair' WHEN grouping(f) = 0 THEN 'generator' WHEN grouping(r) = 0 THEN 'source' ELSE 'all' END AS level,
  f AS generator, r AS real_source, CAST(sum(wins2) AS DOUBLE) / (2 * CAST(sum(pn) AS DOUBLE)) AS auc FROM prs GROUP BY GROUPING SETS (({k}f, r), ({k}f), ({k}r), ({kk})))
"""


def grouped_sql(view: str, keys: list[str], tail: str, score: str = "score", fake: str = "generator", real: str = "real_source") -> str:
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join(f"fakes.{x} = q.{x}" for x in keys) or "TRUE"
    return WINS_SQL.format(k=k, kk=", ".join(keys), fk="".join(f"fakes.{x}, " for x in keys), on=on, v=view, s=score, f=fake, r=real) + tail


@query("agg01_auc_overall", sql(auc_sql("big_v", []), "big_v"))
def agg01(spark, d):
    return M.auc(B.big(spark, d))


OFFICIAL_TAIL = """SELECT {k}clean_auc, pooled_auc, n_clean, n_pooled, 0.5 * clean_auc + 0.5 * pooled_auc AS official_score FROM (
  SELECT {k}max(auc) FILTER (WHERE view = 'clean') AS clean_auc, max(auc) FILTER (WHERE view = 'pooled') AS pooled_auc,
    max(n_pos + n_neg) FILTER (WHERE view = 'clean') AS n_clean, max(n_pos + n_neg) FILTER (WHERE view = 'pooled') AS n_pooled FROM a {g})"""


@query("agg02_official_score", sql("WITH " + POOLED_SQL + ", a AS (WITH " + auc_sql("pooled", ["view"])[5:] + ") " + OFFICIAL_TAIL.format(k="", g=""), "predictions2_v"))
def agg02(spark, d):
    return M.official(B.predictions(spark, d))


@query("agg03_auc_by_condition", sql(auc_sql("predictions_v", ["idx", "condition"]), "predictions_v"))
def agg03(spark, d):
    return M.auc(B.predictions(spark, d), ["idx", "condition"])


@query("agg04_pooled_groups", sql("WITH " + POOLED_SQL + ", " + grouped_sql("pooled", ["view"], "SELECT * FROM grp")[5:], "predictions2_v"))
def agg04(spark, d):
    return M.grouped_auc(M.pooled(B.predictions(spark, d)), ["view"])


RATE_SQL = """SELECT condition, label, CASE WHEN label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END AS group_name, count(*) AS n_rows,
  count(*) FILTER (WHERE CASE WHEN label = 1 THEN score >= 0.5 ELSE score < 0.5 END) AS n_right FROM predictions_v GROUP BY 1, 2, 3"""


@query("agg05_generator_source_rates", sql(RATE_SQL, "predictions_v"))
def agg05(spark, d):
    key = C.group_key(F.col("label"), F.col("generator"), F.col("real_source"))
    return M.rates(B.predictions(spark, d), ["condition"], key)


@query("agg06_source_auc", sql(grouped_sql("predictions_v", ["condition"], "SELECT condition, real_source, auc FROM grp WHERE level = 'source'"), "predictions_v"))
def agg06(spark, d):
    return M.grouped_auc(B.predictions(spark, d), ["condition"]).filter("level = 'source'").select("condition", "real_source", "auc")


@query("agg07_pair_auc", sql(grouped_sql("predictions_v", ["condition"], "SELECT * FROM grp"), "predictions_v"))
def agg07(spark, d):
    return M.grouped_auc(B.predictions(spark, d), ["condition"])


WORST_SQL = "SELECT {k}min(auc) FILTER (WHERE level = 'generator') AS worst_generator_auc, min(auc) FILTER (WHERE level = 'source') AS worst_source_auc, min(auc) FILTER (WHERE level = 'pair') AS worst_pair_auc FROM grp {g}"


@query("agg08_worst_groups", sql(grouped_sql("predictions_v", ["condition"], WORST_SQL.format(k="condition, ", g="GROUP BY condition")), "predictions_v"))
def agg08(spark, d):
    return M.worst(M.grouped_auc(B.predictions(spark, d), ["condition"]), ["condition"])


@query("agg07_pair_auc_big", sql(grouped_sql("big_v", [], "SELECT * FROM grp"), "big_v"))
def agg07_big(spark, d):
    return M.grouped_auc(B.big(spark, d), [])


LONG_SQL = "long_v AS (SELECT idx, condition, sample_id, label, generator, real_source, 'score' AS candidate, score AS value FROM predictions2_v UNION ALL SELECT idx, condition, sample_id, label, generator, real_source, 'score_b', score_b FROM predictions2_v)"


@query("agg09_two_candidates", sql("WITH " + LONG_SQL + ", " + grouped_sql("long_v", ["condition", "candidate"], """, wide AS (SELECT condition, level, generator, real_source, max(auc) FILTER (WHERE candidate = 'score') AS auc_a, max(auc) FILTER (WHERE candidate = 'score_b') AS auc_b FROM grp GROUP BY ALL)
SELECT *, auc_b - auc_a AS delta FROM wide""", "value")[5:], "predictions2_v"))
def agg09(spark, d):
    both = M.unpivot_scores(B.predictions2(spark, d), ["score", "score_b"])
    pick = lambda c: F.max(F.when(F.col("candidate") == c, F.col("auc")))
    wide = M.grouped_auc(both, ["condition", "candidate"]).groupBy("condition", "level", "generator", "real_source").agg(pick("score").alias("auc_a"), pick("score_b").alias("auc_b"))
    return wide.withColumn("delta", F.col("auc_b") - F.col("auc_a"))


@query("agg10_model_distribution", sql(grouped_sql("predictions_v", ["condition"], """SELECT condition, count(*) AS n_models, min(auc) AS min_auc, round(quantile_cont(auc, 0.1), 9) AS q10_auc, round(quantile_cont(auc, 0.5), 9) AS median_auc,
 round(quantile_cont(auc, 0.9), 9) AS q90_auc, count(*) FILTER (WHERE auc < 0.5) AS n_below_50, count(*) FILTER (WHERE auc < 0.7) AS n_below_70 FROM grp WHERE level = 'generator' GROUP BY condition"""), "predictions_v"))
def agg10(spark, d):
    models = M.grouped_auc(B.predictions(spark, d), ["condition"]).filter("level = 'generator'")
    q = lambda p: F.round(F.percentile("auc", p), 9)
    return models.groupBy("condition").agg(F.count(F.lit(1)).alias("n_models"), F.min("auc").alias("min_auc"), q(0.1).alias("q10_auc"), q(0.5).alias("median_auc"), q(0.9).alias("q90_auc"), F.count_if(F.col("auc") < 0.5).alias("n_below_50"), F.count_if(F.col("auc") < 0.7).alias("n_below_70"))


MEANS = "round(avg(score) FILTER (WHERE label = 0), 9) AS real_mean, round(avg(score) FILTER (WHERE label = 1), 9) AS fake_mean"


@query("agg27_class_means", sql(f"SELECT condition, real_mean, fake_mean, real_mean > fake_mean AS inverted FROM (SELECT condition, {MEANS} FROM predictions_v GROUP BY condition)", "predictions_v"))
def agg27(spark, d):
    return M.class_means(B.predictions(spark, d), ["condition"])


PAIRED = """WITH scored AS (SELECT p.condition, q.pair_id, p.label, p.score FROM predictions_v p JOIN pair_v q ON p.sample_id = q.sample_id),
flat AS (SELECT condition, pair_id, max(score) FILTER (WHERE label = 1) AS fake, max(score) FILTER (WHERE label = 0) AS real FROM scored GROUP BY ALL)
SELECT condition, count(*) AS n_pairs, CAST(sum(CASE WHEN fake > real THEN 2 WHEN fake = real THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*)) AS paired_accuracy FROM flat GROUP BY condition"""


def paired(spark, d):
    return B.predictions(spark, d).join(B.pairs(spark, d).select("sample_id", "pair_id"), "sample_id")


@query("agg28_paired_accuracy", sql(PAIRED, "predictions_v", "pair_v"))
def agg28(spark, d):
    return M.paired_accuracy(paired(spark, d), ["condition"])


@query("agg29_pair_generator_metrics", sql("""WITH scored AS (SELECT p.condition, q.pair_id, p.label, p.score, p.generator FROM predictions_v p JOIN pair_v q ON p.sample_id = q.sample_id),
gens AS (SELECT condition, pair_id, generator AS paired_generator FROM scored WHERE label = 1), tagged AS (SELECT s.*, g.paired_generator FROM scored s JOIN gens g USING (condition, pair_id)),
""" + auc_sql("tagged", ["condition", "paired_generator"])[5:], "predictions_v", "pair_v"))
def agg29(spark, d):
    rows = paired(spark, d).select("condition", "pair_id", "label", "score", "generator")
    tag = rows.filter("label = 1").select("condition", "pair_id", F.col("generator").alias("paired_generator"))
    return M.auc(rows.join(tag, ["condition", "pair_id"]), ["condition", "paired_generator"])


SUB = {"short": "n_text < 1000", "english": "format = 'en'", "short_english": "n_text < 1000 AND format = 'en'"}


@query("agg30_metadata_subgroups", sql("WITH sub AS (SELECT m.label, ((m.sample_id * 7919) % 800) / CAST(1000 AS DOUBLE) AS score, s.subgroup FROM meta_v m JOIN LATERAL (SELECT unnest(list_filter([" + "'all', " + ", ".join(f"CASE WHEN {v.replace('n_text', 'm.n_text').replace('format', 'm.format')} THEN '{k}' END" for k, v in SUB.items()) + "], lambda x: x IS NOT NULL)) AS subgroup) s ON TRUE), " + auc_sql("sub", ["subgroup"])[5:], "meta_v"))
def agg30(spark, d):
    rows = B.meta(spark, d).withColumn("score", (F.col("sample_id") * 7919 % 800) / F.lit(1000.0))
    return M.subgroup_auc(rows, {k: F.expr(v) for k, v in SUB.items()})


NOISE = "((sample_id * 31 + idx * 17) % 100) / CAST(1000 AS DOUBLE)"


@query("agg31_route_rate", sql(f"""SELECT condition, count(*) FILTER (WHERE noise >= 0.055) / CAST(count(*) AS DOUBLE) AS route_rate, min(noise) AS min_noise, max(noise) AS max_noise, min(noise) >= 0.055 AS all_routed
FROM (SELECT *, {NOISE} AS noise FROM predictions_v) GROUP BY condition""", "predictions_v"))
def agg31(spark, d):
    rows = B.predictions(spark, d).withColumn("noise", (F.col("sample_id") * 31 + F.col("idx") * 17) % 100 / F.lit(1000.0))
    return rows.groupBy("condition").agg((F.count_if(F.col("noise") >= 0.055) / F.count(F.lit(1)).cast("double")).alias("route_rate"), F.min("noise").alias("min_noise"), F.max("noise").alias("max_noise"), (F.min("noise") >= 0.055).alias("all_routed"))


@query("agg32_score_drift", sql("""WITH c AS (SELECT sample_id, label, score, score_b FROM predictions2_v WHERE condition = 'clean'), pairs_c AS (SELECT sum(CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1 ELSE 0 END) / CAST(2 * count(*) AS DOUBLE) AS one, sum(CASE WHEN p.score_b > n.score_b THEN 2 WHEN p.score_b = n.score_b THEN 1 ELSE 0 END) / CAST(2 * count(*) AS DOUBLE) AS two FROM c p JOIN c n ON p.label = 1 AND n.label = 0), moves AS (SELECT round(abs(one - two), 9) AS moved FROM pairs_c),
r AS (SELECT *, row_number() OVER (ORDER BY score, sample_id) AS r1, row_number() OVER (ORDER BY score_b, sample_id) AS r2 FROM c)
SELECT count(*) AS n_rows, round(max(abs(score - score_b)), 9) AS max_change, round(avg(abs(score - score_b)), 9) AS mean_change, max(abs(r1 - r2)) AS max_rank_change, max(abs(score - score_b)) = 0 AS exact, any_value(moved) AS auc_change, max(abs(score - score_b)) <= 1e-6 AND any_value(moved) <= 1e-6 AS within FROM r CROSS JOIN moves""", "predictions2_v"))
def agg32(spark, d):
    clean = B.predictions2(spark, d).filter("condition = 'clean'").select("sample_id", "label", "score", "score_b")
    return M.drift(clean.select("sample_id", "label", "score"), clean.select("sample_id", "label", F.col("score_b").alias("score")), "sample_id")


@query("agg34_selected_official", sql("WITH a AS (WITH " + auc_sql("predictions_v", ["condition"])[5:] + ") SELECT round(0.5 * (max(auc) FILTER (WHERE condition = 'clean') + avg(auc) FILTER (WHERE condition <> 'clean')), 9) AS selected_official FROM a", "predictions_v"))
def agg34(spark, d):
    by = M.auc(B.predictions(spark, d), ["condition"])
    clean = F.max(F.when(F.col("condition") == "clean", F.col("auc")))
    return by.agg(F.round(0.5 * (clean + F.avg(F.when(F.col("condition") != "clean", F.col("auc")))), 9).alias("selected_official"))


@query("prj06_blend_auc", sql("WITH b AS (SELECT condition, label, 0.75 * score + 0.25 * score_b AS score FROM predictions2_v), " + auc_sql("b", ["condition"])[5:], "predictions2_v"))
def prj06(spark, d):
    rows = B.predictions2(spark, d).withColumn("score", C.blend(F.col("score"), F.col("score_b"), 0.75))
    return M.auc(rows, ["condition"])


@query("prj07_view_policies", sql("""SELECT w.policy, p.condition, p.sample_id, round(w.a * score + w.b * score_b, 9) AS score FROM predictions2_v p
CROSS JOIN (VALUES ('reference', 1.0::DOUBLE, 0.0::DOUBLE), ('mean', 0.5, 0.5), ('three_to_one', 0.75, 0.25)) w(policy, a, b)""", "predictions2_v"))
def prj07(spark, d):
    policies = {"reference": (1.0, 0.0), "mean": (0.5, 0.5), "three_to_one": (0.75, 0.25)}
    weights = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in policies.items()])
    return B.predictions2(spark, d).withColumn("w", F.explode(weights)).select("w.policy", "condition", "sample_id", F.round(F.col("w.a") * F.col("score") + F.col("w.b") * F.col("score_b"), 9).alias("score"))


@query("prj08_quality_routing", sql(f"SELECT condition, sample_id, noise >= 0.055 AS is_routed, round(0.75 * score + 0.25 * score_b, 9) AS general, round(CASE WHEN noise >= 0.055 THEN score_b ELSE 0.75 * score + 0.25 * score_b END, 9) AS routed FROM (SELECT *, {NOISE} AS noise FROM predictions2_v)", "predictions2_v"))
def prj08(spark, d):
    noise = (F.col("sample_id") * 31 + F.col("idx") * 17) % 100 / F.lit(1000.0)
    a, b = F.col("score"), F.col("score_b")
    return B.predictions2(spark, d).select("condition", "sample_id", (noise >= 0.055).alias("is_routed"), F.round(C.blend(a, b, 0.75), 9).alias("general"), F.round(C.routed(noise, a, b, b), 9).alias("routed"))


HEAD = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_W = "[" + ", ".join(f"{w}::DOUBLE" for w in HEAD) + "]"


@query("prj09_linear_head", f"SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ({_W})[i])) + 0.1))), 9) AS probability FROM embeddings")
def prj09(spark, d):
    return B.vectors(spark, d).select("vec_id", F.round(C.linear_head(F.col("embedding"), HEAD, 0.1), 9).alias("probability"))


@query("prj10_positive_head", f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: greatest(CAST(embedding[i] AS DOUBLE), 0) * greatest(({_W})[i], 0))) + 0.1, 9) AS evidence FROM embeddings")
def prj10(spark, d):
    return B.vectors(spark, d).select("vec_id", F.round(C.positive_head(F.col("embedding"), HEAD, 0.1), 9).alias("evidence"))


@query("jn24_candidate_delta", sql("WITH " + LONG_SQL + ", a AS (WITH " + auc_sql("long_v", ["condition", "candidate"], "value")[5:] + ") SELECT x.condition, x.auc AS auc_a, y.auc AS auc_b, y.auc - x.auc AS delta FROM a x JOIN a y ON x.condition = y.condition AND x.candidate = 'score' AND y.candidate = 'score_b'", "predictions2_v"))
def jn24(spark, d):
    by = M.auc(M.unpivot_scores(B.predictions2(spark, d), ["score", "score_b"]), ["condition", "candidate"])
    pick = lambda c: F.max(F.when(F.col("candidate") == c, F.col("auc")))
    return by.groupBy("condition").agg(pick("score").alias("auc_a"), pick("score_b").alias("auc_b")).withColumn("delta", F.col("auc_b") - F.col("auc_a"))
