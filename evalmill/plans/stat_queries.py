"""Queries on errors, thresholds, ranked rows, summaries and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import errors as E
from evalmill.operators import replicates as P
from evalmill.operators import sample as S
from evalmill.operators import stats as T
from evalmill.plans import bindings as B
from evalmill.plans.bindings import sql
from evalmill.plans.metric_queries import auc_sql, grouped_sql
from evalmill.plans.registry import query

GROUP = "CASE WHEN label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END"


def group():
    return C.group_key(F.col("label"), F.col("generator"), F.col("real_source"))


@query("agg11_error_summary", sql("""SELECT *, n_fp / CAST(n_real AS DOUBLE) AS fp_rate, n_fn / CAST(n_fake AS DOUBLE) AS fn_rate, 1 - 0.5 * (n_fp / CAST(n_real AS DOUBLE) + n_fn / CAST(n_fake AS DOUBLE)) AS balanced_accuracy FROM (
SELECT condition, count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 1) AS n_fake, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS n_fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS n_fn FROM predictions_v GROUP BY condition)""", "predictions_v"))
def agg11(spark, d):
    return E.error_summary(B.predictions(spark, d), ["condition"])


@query("agg12_group_errors", sql(f"""SELECT condition, label, {GROUP} AS group_name, count(*) AS n_rows, count(*) FILTER (WHERE (label = 0 AND score >= 0.5) OR (label = 1 AND score < 0.5)) AS n_errors,
count(*) FILTER (WHERE (label = 0 AND score >= 0.5) OR (label = 1 AND score < 0.5)) / CAST(count(*) AS DOUBLE) AS error_rate, round(avg(score), 9) AS mean_score FROM predictions_v GROUP BY 1, 2, 3""", "predictions_v"))
def agg12(spark, d):
    wrong = ((F.col("label") == 0) & (F.col("score") >= 0.5)) | ((F.col("label") == 1) & (F.col("score") < 0.5))
    return E.group_errors(B.predictions(spark, d), ["condition"], group(), wrong)


SWEEP = f"""WITH rows_g AS (SELECT label, score, {GROUP} AS g FROM {{v}}), marks AS (SELECT DISTINCT score AS t FROM rows_g UNION SELECT unnest([0.0::DOUBLE, 0.5, 1.0])),
gs AS (SELECT g, label, count(*) AS total FROM rows_g GROUP BY ALL), cells AS (SELECT g, label, score AS t, count(*) AS n FROM rows_g GROUP BY ALL),
run AS (SELECT g, label, t, total, coalesce(sum(n) OVER (PARTITION BY g, label ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT gs.g, gs.label, gs.total, m.t, coalesce(c.n, 0) AS n FROM gs CROSS JOIN marks m LEFT JOIN cells c ON c.g = gs.g AND c.label = gs.label AND c.t = m.t)),
ok AS (SELECT *, CASE WHEN label = 0 THEN below ELSE total - below END AS good FROM run),
swept AS (SELECT t AS threshold, min(good / CAST(total AS DOUBLE)) AS min_recall, 0.5 * (CAST(sum(good) FILTER (WHERE label = 0) AS BIGINT) / CAST(sum(total) FILTER (WHERE label = 0) AS DOUBLE) + CAST(sum(good) FILTER (WHERE label = 1) AS BIGINT) / CAST(sum(total) FILTER (WHERE label = 1) AS DOUBLE)) AS balanced_accuracy FROM ok GROUP BY t)
"""


@query("agg13_threshold_metrics", sql("WITH clean AS (SELECT * FROM predictions_v WHERE condition = 'clean'), " + SWEEP.format(v="clean")[5:] + "SELECT * FROM swept", "predictions_v"))
def agg13(spark, d):
    return E.threshold_sweep(B.predictions(spark, d).filter("condition = 'clean'"), group())


@query("agg14_select_threshold", sql(SWEEP.format(v="big_v") + "SELECT * FROM swept ORDER BY min_recall DESC, balanced_accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1", "big_v"))
def agg14(spark, d):
    return E.select_threshold(E.threshold_sweep(B.big(spark, d), group(), best_only=True))


@query("agg15_container_summary", sql("""SELECT level, level_key, count(*) AS n_rows, min(bytes) AS min_bytes, median(bytes) AS median_bytes, max(bytes) AS max_bytes, min(n_text) AS min_n_text, median(n_text) AS median_n_text, max(n_text) AS max_n_text
FROM (SELECT *, 'label' AS level, CAST(label AS VARCHAR) AS level_key FROM meta_v UNION ALL SELECT *, 'source', mode FROM meta_v) GROUP BY 1, 2""", "meta_v"))
def agg15(spark, d):
    return T.container_summary(B.meta(spark, d), {"label": F.col("label"), "source": F.col("mode")}, ["bytes", "n_text"])


@query("agg15_top_dimensions", sql("SELECT label, size_bucket, n_rows, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_rows DESC, size_bucket) AS place FROM (SELECT label, size_bucket, count(*) AS n_rows FROM meta_v GROUP BY 1, 2)) WHERE place <= 12", "meta_v"))
def agg15b(spark, d):
    return T.top_values(B.meta(spark, d), ["label"], "size_bucket", 12)


@query("agg16_group_counts", sql(f"SELECT label, {GROUP} AS group_name, count(*) AS n_rows FROM manifest_v GROUP BY 1, 2", "manifest_v"))
def agg16(spark, d):
    return B.manifest(spark, d).groupBy("label", group().alias("group_name")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("agg17_coverage_inventory", sql("SELECT generator, count(*) AS n_rows, count(DISTINCT content_sha256) AS n_contents FROM manifest_v WHERE label = 1 GROUP BY 1", "manifest_v"))
def agg17(spark, d):
    return B.manifest(spark, d).filter("label = 1").groupBy("generator").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("content_sha256").alias("n_contents"))


@query("agg18_label_balance", sql("SELECT count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 1) AS n_fake, count(*) FILTER (WHERE label = 0) = count(*) FILTER (WHERE label = 1) AS balanced FROM manifest_v", "manifest_v"))
def agg18(spark, d):
    return B.manifest(spark, d).agg(F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"), (F.count_if(F.col("label") == 0) == F.count_if(F.col("label") == 1)).alias("balanced"))


@query("agg19_distribution", """SELECT event_type, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, min(value) AS min, round(quantile_cont(value, 0.05), 9) AS q05, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.95), 9) AS q95, max(value) AS max,
count(*) FILTER (WHERE value >= 0.5) / CAST(count(value) AS DOUBLE) AS share_from_half FROM events GROUP BY event_type""")
def agg19(spark, d):
    return T.distribution(B.table(spark, d, "events"), ["event_type"], "value")


def tree_sql(lines: str, *keys: str) -> str:
    """The tree of digests over ``lines``: by four digits of a line's hash, then two, then one for each key."""
    k, n = "".join(f"{x}, " for x in keys), len(keys)
    by = lambda m: "GROUP BY " + ", ".join(str(i + 1) for i in range(n + m)) if n + m else ""
    up = lambda part, source, m: f"SELECT {k}{part}CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(part || digest, chr(10) ORDER BY part || digest)) AS digest FROM {source} {by(m)}"
    return (
        f"WITH l AS ({lines}), p4 AS (SELECT {k}substr(sha256(line), 1, 4) AS part, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l {by(1)}), "
        f"p2 AS ({up('substr(part, 1, 2) AS part, ', 'p4', 1)}), p0 AS ({up('', 'p2', 0)}) SELECT {k}n AS n_lines, digest FROM p0"
    )


@query("agg20_inventory_digest", sql(tree_sql("SELECT path || ' ' || content_sha256 AS line FROM manifest_v"), "manifest_v"))
def agg20(spark, d):
    return T.inventory_digest(B.manifest(spark, d), F.concat_ws(" ", "path", "content_sha256"))


@query("agg20_inventory_digest_ranged", sql("WITH l AS (SELECT path || ' ' || content_sha256 AS line FROM manifest_v), p AS (SELECT substr(sha256(line), 1, 2) AS part, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_lines, sha256(string_agg(part || digest, chr(10) ORDER BY part || digest)) AS digest FROM p", "manifest_v"))
def agg20b(spark, d):
    return T.inventory_digest_ranged(B.manifest(spark, d), F.concat_ws(" ", "path", "content_sha256"))


@query("agg21_balanced_effects", sql("""WITH m AS (SELECT score AS v, avg(score) OVER (PARTITION BY prompt_id) AS ma, avg(score) OVER (PARTITION BY generator) AS mb, avg(score) OVER () AS m FROM grid_v),
s AS (SELECT sum((v - m) ^ 2) AS t, sum((ma - m) ^ 2) AS sa, sum((mb - m) ^ 2) AS sb FROM m) SELECT round(sa / t, 9) AS prompt_id_share, round(sb / t, 9) AS generator_share, round(greatest(0, t - sa - sb) / t, 9) AS rest_share FROM s""", "grid_v"))
def agg21(spark, d):
    return T.balanced_effects(B.grid(spark, d), "prompt_id", "generator", "score")


@query("agg21_balance_check", sql("""WITH c AS (SELECT prompt_id, generator, count(*) AS n FROM grid_v GROUP BY 1, 2), r AS (SELECT count(DISTINCT prompt_id) AS n_a, count(DISTINCT generator) AS n_b, count(*) AS n_cells, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(0 AS BIGINT) AS n_unnamed FROM c)
SELECT *, n_a * n_b - n_cells AS n_missing, n_a * n_b = n_cells AND n_repeated = 0 AS balanced FROM r""", "grid_v"))
def agg21b(spark, d):
    return T.balance_report(B.grid(spark, d), "prompt_id", "generator")


SHARE = "round(coalesce((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 0), 9)"


@query("agg22_between_share", sql(f"WITH g AS (SELECT condition, real_source, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM predictions_v WHERE label = 0 GROUP BY 1, 2) SELECT condition, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups, {SHARE} AS share FROM g GROUP BY condition", "predictions_v"))
def agg22(spark, d):
    return T.between_share(B.predictions(spark, d).filter("label = 0"), ["condition"], "real_source", "score")


@query("agg23_centroids", """WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
SELECT label, CAST(i AS INTEGER) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""")
def agg23(spark, d):
    return T.centroids(B.vectors(spark, d), "label", "embedding")


@query("agg24_permutation_test", sql(f"""WITH b AS (SELECT sample_id, real_source, CAST(bytes AS DOUBLE) AS bytes, row_number() OVER (ORDER BY sample_id) AS at FROM manifest_v WHERE label = 0),
r AS (SELECT k AS replicate, bytes, row_number() OVER (PARTITION BY k ORDER BY sha256(concat('7:', CAST(k AS VARCHAR), ':', CAST(sample_id AS VARCHAR)))) AS at FROM b CROSS JOIN (SELECT unnest(range(0, 10000)) AS k)),
l AS (SELECT r.replicate, r.bytes, b.real_source FROM r JOIN b ON r.at = b.at), g AS (SELECT replicate, real_source, count(*) AS n, sum(bytes) AS s, sum(bytes * bytes) AS q FROM l GROUP BY 1, 2), sh AS (SELECT replicate, {SHARE} AS share FROM g GROUP BY 1),
og AS (SELECT real_source, count(*) AS n, sum(bytes) AS s, sum(bytes * bytes) AS q FROM b GROUP BY 1), o AS (SELECT {SHARE} AS observed FROM og)
SELECT max(observed) AS observed, count(*) FILTER (WHERE share >= observed) AS n_exceed, (count(*) FILTER (WHERE share >= observed) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value FROM sh CROSS JOIN o""", "manifest_v"))
def agg24(spark, d):
    rows = B.manifest(spark, d).filter("label = 0").withColumn("bytes", F.col("bytes").cast("double"))
    return T.permutation_test(rows, "sample_id", "real_source", "bytes", 10_000, 7)


def boot_auc(s: str) -> str:
    return f"(WITH c AS (SELECT replicate, {s} AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM t GROUP BY 1, 2), l AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY s) AS le FROM c) SELECT replicate, CAST(sum(p * (2 * (le - n) + n)) AS DOUBLE) / (2 * CAST(sum(p) * sum(n) AS DOUBLE)) AS auc FROM l GROUP BY 1)"


@query("agg25_bootstrap_auc", sql(f"""WITH k AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS pos_at, score, score_b FROM predictions2_v WHERE condition = 'clean'), z AS (SELECT label, max(pos_at) AS n FROM k GROUP BY 1),
dr AS (SELECT r AS replicate, label, n, unnest(range(1, n + 1)) AS draw FROM z CROSS JOIN (SELECT unnest(range(0, 2000)) AS r)),
t AS (SELECT dr.replicate, k.* FROM (SELECT replicate, label, CAST(('0x' || substr(sha256(concat_ws(':', '11', replicate, label, draw)), 1, 12)) AS BIGINT) % n + 1 AS pos_at FROM dr) dr JOIN k USING (label, pos_at)),
w AS (SELECT a.auc AS auc_a, b.auc AS auc_b, b.auc - a.auc AS delta FROM {boot_auc('score')} a JOIN {boot_auc('score_b')} b USING (replicate)),
x AS (SELECT 'auc_a' AS metric, auc_a AS v FROM w UNION ALL SELECT 'auc_b', auc_b FROM w UNION ALL SELECT 'delta', delta FROM w)
SELECT metric, round(quantile_cont(v, 0.025), 9) AS q025, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.975), 9) AS q975 FROM x GROUP BY 1""", "predictions2_v"))
def agg25(spark, d):
    return P.stratified_bootstrap_auc(B.predictions2(spark, d).filter("condition = 'clean'"), "sample_id", "score", "score_b", 2000, 11)


@query("top01_ranked_errors", sql("""WITH l AS (SELECT condition, path, label, score, unnest(list_filter([CASE WHEN label = 0 THEN 'top_real' END, CASE WHEN label = 1 THEN 'bottom_fake' END, CASE WHEN label = 0 AND score >= 0.5 THEN 'false_positive' END, CASE WHEN label = 1 AND score < 0.5 THEN 'false_negative' END], lambda x: x IS NOT NULL)) AS list_name FROM predictions_v),
r AS (SELECT *, row_number() OVER (PARTITION BY condition, list_name ORDER BY CASE WHEN label = 0 THEN -score ELSE score END, path) AS place FROM l) SELECT condition, list_name, place, path, score FROM r WHERE place <= 5""", "predictions_v"))
def top01(spark, d):
    return E.ranked_errors(B.predictions(spark, d), ["condition"], 5)


@query("top03_worst_pairs", sql(grouped_sql("predictions_v", ["condition"], "SELECT condition, generator, real_source, auc, place FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY auc, generator, real_source) AS place FROM grp WHERE level = 'pair') WHERE place <= 10"), "predictions_v"))
def top03(spark, d):
    from evalmill.operators.metrics import grouped_auc

    pairs = grouped_auc(B.predictions(spark, d), ["condition"]).filter("level = 'pair'").drop("level")
    return E.lowest(pairs, ["condition"], "auc", 10, "generator", "real_source")


@query("top04_conditions_ranked", sql("WITH a AS (WITH " + auc_sql("predictions_v", ["idx", "condition"])[5:] + ") SELECT idx, condition, auc, row_number() OVER (ORDER BY auc, idx) AS place FROM a", "predictions_v"))
def top04(spark, d):
    from evalmill.operators.metrics import auc

    return E.lowest(auc(B.predictions(spark, d), ["idx", "condition"]).select("idx", "condition", "auc"), [], "auc", None, "idx")


@query("top07_groups_ranked", sql("SELECT real_source, mean_score, row_number() OVER (ORDER BY mean_score DESC, real_source) AS place FROM (SELECT real_source, round(avg(score), 9) AS mean_score FROM predictions_v WHERE label = 0 GROUP BY 1)", "predictions_v"))
def top07(spark, d):
    means = B.predictions(spark, d).filter("label = 0").groupBy("real_source").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    return E.lowest(means.withColumn("down", -F.col("mean_score")), [], "down", None, "real_source").drop("down")


RANK = "sha256(concat_ws(':', '{seed}', '{ns}', {ids}))"


def rank_sql(seed: int, ns: str, *ids: str) -> str:
    return RANK.format(seed=seed, ns=ns, ids=", ".join(f"CAST({i} AS VARCHAR)" for i in ids))


@query("smp01_hash_rank_per_group", sql(f"SELECT sample_id, group_name, place FROM (SELECT *, {GROUP} AS group_name, row_number() OVER (PARTITION BY label, {GROUP} ORDER BY {rank_sql(3, 'gate', 'sample_id')}) AS place FROM manifest_v) WHERE place <= 5", "manifest_v"))
def smp01(spark, d):
    rows = B.manifest(spark, d).withColumn("group_name", group())
    return S.lowest_ranked(rows, ["label", "group_name"], 5, S.rank_of(3, "gate", "sample_id")).select("sample_id", "group_name", "place")


@query("smp01_shortages", sql(f"SELECT label, {GROUP} AS group_name, count(*) AS n_rows FROM manifest_v GROUP BY 1, 2 HAVING count(*) < 5", "manifest_v"))
def smp01b(spark, d):
    return S.shortages(B.manifest(spark, d).withColumn("group_name", group()), ["label", "group_name"], 5)


@query("smp02_global_top", sql(f"SELECT sample_id, {rank_sql(5, 'top', 'sample_id')} AS rank FROM big_v ORDER BY rank LIMIT 100", "big_v"))
def smp02(spark, d):
    return S.global_top(B.big(spark, d), 100, S.rank_of(5, "top", "sample_id")).select("sample_id", "rank")


@query("smp03_rank_window", sql("SELECT sample_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY content_sha256, sample_id) AS place FROM manifest_v) WHERE place BETWEEN 11 AND 20", "manifest_v"))
def smp03(spark, d):
    return S.rank_window(B.manifest(spark, d), ["label"], 10, 10, F.struct("content_sha256", "sample_id")).select("sample_id", "label", "place")


@query("smp04_fresh_content_rank", sql("""WITH used AS (SELECT DISTINCT content_sha256 FROM split_v WHERE role = 'train'), one AS (SELECT content_sha256, label, min(path) AS path FROM split_v WHERE role = 'eval' AND content_sha256 NOT IN (SELECT content_sha256 FROM used) GROUP BY 1, 2)
SELECT label, path, content_sha256, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY content_sha256) AS place FROM one) WHERE place <= 20""", "split_v"))
def smp04(spark, d):
    rows = B.split(spark, d)
    fresh = rows.filter("role = 'eval'").join(rows.filter("role = 'train'").select("content_sha256"), "content_sha256", "left_anti")
    return S.lowest_ranked(fresh.groupBy("content_sha256", "label").agg(F.min("path").alias("path")), ["label"], 20, F.col("content_sha256")).select("label", "path", "content_sha256", "place")


@query("smp05_balanced_limit", sql(f"SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(42, 'limit', 'sample_id')}) AS place FROM manifest_v) WHERE place <= 25", "manifest_v"))
def smp05(spark, d):
    return S.lowest_ranked(B.manifest(spark, d), ["label"], 25, S.rank_of(42, "limit", "sample_id")).select("sample_id", "label")


@query("smp07_group_cap", sql(f"SELECT sample_id, real_source FROM (SELECT *, row_number() OVER (PARTITION BY real_source ORDER BY {rank_sql(9, 'cap', 'sample_id')}) AS place FROM manifest_v WHERE label = 0) WHERE place <= 30", "manifest_v"))
def smp07(spark, d):
    return S.lowest_ranked(B.manifest(spark, d).filter("label = 0"), ["real_source"], 30, S.rank_of(9, "cap", "sample_id")).select("sample_id", "real_source")


@query("smp08_equal_allocation", sql(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY real_source ORDER BY {rank_sql(4, 'quota', 'sample_id')}) AS place FROM manifest_v WHERE label = 0), g AS (SELECT real_source, row_number() OVER (ORDER BY real_source) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT real_source FROM r))
SELECT sample_id, r.real_source, place, 50 // k + CASE WHEN i < 50 % k THEN 1 ELSE 0 END AS quota FROM r JOIN g ON r.real_source = g.real_source WHERE place <= 50 // k + CASE WHEN i < 50 % k THEN 1 ELSE 0 END""", "manifest_v"))
def smp08(spark, d):
    rows = B.manifest(spark, d).filter("label = 0")
    return S.allocate(rows, "real_source", 50, S.rank_of(4, "quota", "sample_id")).select("sample_id", "real_source", "place", "quota")


@query("smp09_matched_strata", sql(f"""WITH q AS (SELECT format, size_bucket, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS quota FROM meta_v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY format, size_bucket, label ORDER BY {rank_sql(6, 'strata', 'sample_id')}) AS place FROM meta_v)
SELECT r.sample_id, r.format, r.size_bucket, r.label, r.place FROM r JOIN q USING (format, size_bucket) WHERE place <= quota""", "meta_v"))
def smp09(spark, d):
    return S.matched_strata(B.meta(spark, d), ["format", "size_bucket"], S.rank_of(6, "strata", "sample_id")).select("sample_id", "format", "size_bucket", "label", "place")


UNIT = "(CAST(('0x' || substr({r}, 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query("smp10_spread_windows", sql(f"""WITH p AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS pos_at, count(*) OVER () AS n FROM manifest_v), b AS (SELECT *, pos_at * 5 // n AS block FROM p), s AS (SELECT block, min(pos_at) AS low, count(*) AS size FROM b GROUP BY 1),
t AS (SELECT block, low + CAST(floor({UNIT.format(r=rank_sql(8, 'window', 'block'))} * greatest(1, size - 4 + 1)) AS BIGINT) AS start FROM s) SELECT sample_id, block, pos_at FROM b JOIN t USING (block) WHERE pos_at BETWEEN start AND start + 3""", "manifest_v"))
def smp10(spark, d):
    return S.spread_windows(B.manifest(spark, d).select("sample_id"), ["sample_id"], 20, 5, 8).select("sample_id", "block", F.col("at").alias("pos_at"))


@query("smp11_first_valid", sql("""WITH c AS (SELECT sample_id, real_source, bytes >= 500 AS valid, sum(CASE WHEN bytes >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY real_source ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS n_valid FROM manifest_v WHERE label = 0)
SELECT sample_id, real_source, valid AS kept FROM c WHERE (valid AND n_valid <= 10) OR (NOT valid AND n_valid < 10)""", "manifest_v"))
def smp11(spark, d):
    rows = B.manifest(spark, d).filter("label = 0")
    return S.first_valid(rows, ["real_source"], ["sample_id"], F.col("bytes") >= 500, 10).select("sample_id", "real_source", "kept")


@query("smp12_first_per_source", """WITH m AS (SELECT doc_id, source, CASE WHEN lang <> 'en' THEN 'lang' WHEN n_chars < 200 THEN 'short' END AS reason FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source, reason IS NULL ORDER BY doc_id) AS place FROM m)
SELECT doc_id, source, coalesce(reason, CASE WHEN place > 8 THEN 'cap' END) AS reason FROM p""")
def smp12(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return S.first_per_group(docs, "source", "doc_id", 8, F.when(F.col("lang") != "en", "lang").when(F.col("n_chars") < 200, "short")).select("doc_id", "source", "reason")


@query("smp15_balanced_weights", sql(f"""WITH g AS (SELECT label, {GROUP} AS group_name, count(*) AS n FROM manifest_v GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM g GROUP BY 1)
SELECT sample_id, 1 / CAST(k.k * g.n AS DOUBLE) AS weight FROM manifest_v m JOIN g ON g.label = m.label AND g.group_name = CASE WHEN m.label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END JOIN k ON k.label = m.label""", "manifest_v"))
def smp15(spark, d):
    return S.balanced_weights(B.manifest(spark, d), group()).select("sample_id", "weight")


BLOCK = "CASE WHEN sample_id % 5 = 0 THEN 'frontier' ELSE 'legacy' END"


@query("smp17_block_weights", sql(f"""WITH t AS (SELECT sample_id, label, {BLOCK} AS block, {GROUP} AS g FROM manifest_v), s AS (SELECT block, label, g, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT block, label, count(*) AS k FROM s GROUP BY ALL)
SELECT sample_id, t.block, 0.5 * CASE WHEN t.block = 'frontier' THEN 0.15 ELSE 0.85 END / CAST(k * n AS DOUBLE) AS weight FROM t JOIN s USING (block, label, g) JOIN k USING (block, label)""", "manifest_v"))
def smp17(spark, d):
    block = F.when(F.col("sample_id") % 5 == 0, "frontier").otherwise("legacy")
    return S.block_weights(B.manifest(spark, d), block, group(), {"frontier": 0.15, "legacy": 0.85}).select("sample_id", "block", "weight")


@query("agg36_block_mass", sql(f"SELECT block, CAST(round(CASE WHEN block = 'frontier' THEN 0.15 ELSE 0.85 END * 0.5 * count(DISTINCT label), 9) AS DOUBLE) AS mass FROM (SELECT label, {BLOCK} AS block FROM manifest_v) GROUP BY block", "manifest_v"))
def agg36(spark, d):
    return smp17(spark, d).groupBy("block").agg(F.round(F.sum("weight"), 9).alias("mass"))


@query("smp20_random_condition", sql(f"SELECT sample_id, CASE WHEN {UNIT.format(r=rank_sql(1, 'apply', 'sample_id'))} >= 0.8 THEN 'clean' WHEN {UNIT.format(r=rank_sql(1, 'pick', 'sample_id'))} < 0.25 THEN 'a' WHEN {UNIT.format(r=rank_sql(1, 'pick', 'sample_id'))} < 0.5 THEN 'b' ELSE 'c' END AS train_condition FROM manifest_v", "manifest_v"))
def smp20(spark, d):
    return S.random_condition(B.manifest(spark, d), ["a", "b", "c"], [1, 1, 2], 0.8, 1, "sample_id").select("sample_id", "train_condition")


@query("smp19_weighted_draws", sql(f"""WITH g AS (SELECT label, {GROUP} AS group_name, count(*) AS n FROM manifest_v GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM g GROUP BY 1), w AS (SELECT sample_id, 1 / CAST(k.k * g.n AS DOUBLE) AS weight FROM manifest_v m JOIN g ON g.label = m.label AND g.group_name = CASE WHEN m.label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END JOIN k ON k.label = m.label),
u AS (SELECT *, weight / sum(weight) OVER () * 1000 AS mean, {UNIT.format(r=rank_sql(2, 'draw', 'sample_id'))} AS u FROM w)
SELECT sample_id, round(weight, 9) AS weight, CAST(len(list_filter(range(0, 200), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1)))) <= u)) AS INTEGER) AS times FROM u""", "manifest_v"))
def smp19(spark, d):
    rows = S.balanced_weights(B.manifest(spark, d), group())
    return S.with_replacement(rows, "weight", 1000, 2, "sample_id").select("sample_id", F.round("weight", 9).alias("weight"), "times")


@query("smp19_exact_draws", sql(f"""WITH g AS (SELECT label, {GROUP} AS group_name, count(*) AS n FROM manifest_v GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM g GROUP BY 1), w AS (SELECT sample_id, 1 / CAST(k.k * g.n AS DOUBLE) AS weight FROM manifest_v m JOIN g ON g.label = m.label AND g.group_name = CASE WHEN m.label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END JOIN k ON k.label = m.label),
o AS (SELECT sample_id, CAST(round(weight / 1e-12) AS HUGEINT) AS u, sum(CAST(round(weight / 1e-12) AS HUGEINT)) OVER (ORDER BY sample_id) AS upto FROM w), z AS (SELECT max(upto) AS total FROM o),
d AS (SELECT (CAST(('0x' || substr({rank_sql(4, 'draw', 'i')}, 1, 12)) AS HUGEINT) * total) // 281474976710656::HUGEINT AS place FROM (SELECT unnest(range(0, 1000)) AS i) CROSS JOIN z)
SELECT sample_id, CAST((SELECT count(*) FROM d WHERE d.place >= o.upto - o.u AND d.place < o.upto) AS BIGINT) AS times, CAST(1000 AS BIGINT) AS n_draws FROM o""", "manifest_v"))
def smp19_exact(spark, d):
    """1,000 draws in all, each row as often as its weight takes."""
    drawn = S.exact_draws(S.balanced_weights(B.manifest(spark, d), group()), "weight", 1000, 4, "sample_id")
    return drawn.select("sample_id", "times").crossJoin(F.broadcast(drawn.agg(F.sum("times").alias("n_draws"))))
