"""Queries on filters, contracts, exclusions, leakage, near pairs, matching and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import auction as A
from evalmill.operators import contracts as K
from evalmill.operators import curate as U
from evalmill.operators import decide as D
from evalmill.operators import metrics as M
from evalmill.operators import neighbours as N
from evalmill.operators import stats as T
from evalmill.operators.cosine import cosine_top, search_work
from evalmill.plans import bindings as B
from evalmill.plans.bindings import sql
from evalmill.plans.metric_queries import POOLED_SQL, auc_sql, grouped_sql
from evalmill.plans.registry import query


@query("prj01_group_key", sql("SELECT sample_id, CASE WHEN label = 1 THEN coalesce(generator, 'unknown') ELSE coalesce(real_source, 'unknown') END AS group_name FROM manifest_v", "manifest_v"))
def prj01(spark, d):
    return B.manifest(spark, d).select("sample_id", C.group_key(F.col("label"), F.col("generator"), F.col("real_source")).alias("group_name"))


@query("prj02_first_non_empty", sql("SELECT sample_id, coalesce(nullif(trim(generator), ''), nullif(trim(real_source), ''), 'unspecified') AS name FROM manifest_v", "manifest_v"))
def prj02(spark, d):
    return B.manifest(spark, d).select("sample_id", C.first_non_empty(F.col("generator"), F.col("real_source"), default="unspecified").alias("name"))


@query("prj03_identities", sql("SELECT DISTINCT sample_id, identity FROM (SELECT sample_id, unnest([content_sha256, sha256(path), CASE WHEN label = 1 THEN content_sha256 END]) AS identity FROM manifest_v) WHERE identity IS NOT NULL", "manifest_v"))
def prj03(spark, d):
    ids = C.identities(F.col("content_sha256"), F.sha2("path", 256), F.when(F.col("label") == 1, F.col("content_sha256")))
    return B.manifest(spark, d).select("sample_id", F.explode(ids).alias("identity"))


@query("prj04_provenance_stamp", sql("SELECT sample_id, 'corpus' AS dataset, 'CC-BY-4.0' AS license_id, true AS training_allowed FROM manifest_v", "manifest_v"))
def prj04(spark, d):
    return U.stamp(B.manifest(spark, d).select("sample_id"), dataset="corpus", license_id="CC-BY-4.0", training_allowed=True)


@query("prj05_rebased_paths", sql("SELECT sample_id, CASE WHEN starts_with(path, 'docs/src1/') THEN substr(path, 11) ELSE path END AS path FROM manifest_v", "manifest_v"))
def prj05(spark, d):
    return B.manifest(spark, d).select("sample_id", U.rebase(F.col("path"), "docs/src1").alias("path"))


@query("flt01_forbidden_parts", sql("SELECT sample_id FROM manifest_v WHERE NOT list_has_any(string_split(path, '/'), ['src3', 'src5'])", "manifest_v"))
def flt01(spark, d):
    return B.manifest(spark, d).filter(~C.has_forbidden_part(F.col("path"), ["src3", "src5"])).select("sample_id")


@query("flt02_forbidden_terms", "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'token ='))")
def flt02(spark, d):
    return B.table(spark, d, "documents").filter(~C.has_forbidden_term(F.col("text"), ["License", "token ="])).select("doc_id")


@query("flt03_licence_allow_list", "SELECT lang, count(*) AS n_rows FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang")
def flt03(spark, d):
    return U.license_filter(B.table(spark, d, "documents"), "lang", ["en", "fr"], F.col("source").startswith("src"))[1]


@query("flt04_named_exclusions", sql("SELECT sample_id FROM manifest_v WHERE sample_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)", "manifest_v"))
def flt04(spark, d):
    keys = B.table(spark, d, "labels").filter("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("sample_id"))
    return U.exclude(B.manifest(spark, d), keys, "sample_id")[0].select("sample_id")


@query("flt05_hash_exclusions", sql("SELECT sample_id FROM split_v WHERE role = 'eval' AND content_sha256 NOT IN (SELECT content_sha256 FROM split_v WHERE role = 'train')", "split_v"))
def flt05(spark, d):
    rows = B.split(spark, d)
    return U.exclude(rows.filter("role = 'eval'"), rows.filter("role = 'train'").select("content_sha256").distinct(), "content_sha256")[0].select("sample_id")


@query("flt06_fresh_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 40")
def flt06(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id").withColumn("rank", F.sha2(F.col("doc_id").cast("string"), 256))
    return U.take_fresh(docs, B.table(spark, d, "labels"), "doc_id", ["rank"], 40).select("doc_id")


@query("flt07_split_by_stem", sql("SELECT sample_id, CASE WHEN CAST(regexp_extract(path, '/([0-9]+)\\.txt$', 1) AS BIGINT) < 500 THEN 'train' ELSE 'test' END AS part FROM manifest_v", "manifest_v"))
def flt07(spark, d):
    stem = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("long")
    return B.manifest(spark, d).select("sample_id", F.when(stem < 500, "train").otherwise("test").alias("part"))


@query("flt08_prefix_predicate", sql("SELECT sample_id FROM manifest_v WHERE NOT starts_with(path, 'docs/src1')", "manifest_v"))
def flt08(spark, d):
    return B.manifest(spark, d).filter(~F.col("path").startswith("docs/src1")).select("sample_id")


@query("flt09_low_resolution", sql("SELECT sample_id, bytes < 600 OR (label = 1 AND starts_with(generator, 'src1')) OR (label = 0 AND starts_with(real_source, 'e')) AS is_low FROM manifest_v", "manifest_v"))
def flt09(spark, d):
    low = (F.col("bytes") < 600) | ((F.col("label") == 1) & F.col("generator").startswith("src1")) | ((F.col("label") == 0) & F.col("real_source").startswith("e"))
    return B.manifest(spark, d).select("sample_id", low.alias("is_low"))


@query("flt10_id_list", "SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_distinct, min(item_id) AS low, max(item_id) AS high, count(*) = count(DISTINCT item_id) AND min(item_id) >= 0 AND max(item_id) <= 1000 AS valid FROM benchmark")
def flt10(spark, d):
    return U.id_list_report(B.table(spark, d, "benchmark"), "item_id", 0, 1000)


@query("con01_row_contract", sql("""SELECT CAST(sample_id AS VARCHAR) AS row_key, rule FROM (SELECT sample_id, unnest([CASE WHEN NOT (label IN (0, 1)) THEN 'label' END, CASE WHEN NOT coalesce(bytes >= 300, false) THEN 'size' END,
CASE WHEN NOT coalesce(path LIKE 'docs/%', false) THEN 'path' END, CASE WHEN NOT coalesce(label = 0 OR generator IS NOT NULL, false) THEN 'generator' END]) AS rule FROM manifest_v) WHERE rule IS NOT NULL""", "manifest_v"))
def con01(spark, d):
    rules = {"label": F.col("label").isin(0, 1), "size": F.col("bytes") >= 300, "path": F.col("path").like("docs/%"), "generator": (F.col("label") == 0) | F.col("generator").isNotNull()}
    return K.violations(B.manifest(spark, d), "sample_id", rules)


@query("con02_unique_hashes", sql("SELECT 'unique_content_sha256' AS rule, content_sha256 AS row_key, count(*) AS n_rows FROM manifest_v GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unique_path', path, count(*) FROM manifest_v GROUP BY 2 HAVING count(*) > 1", "manifest_v"))
def con02(spark, d):
    return K.duplicate_violations(B.manifest(spark, d), ["content_sha256", "path"])


@query("con03_paired_contract", sql("SELECT CAST(pair_id AS VARCHAR) AS row_key, 'constant_half' AS rule FROM (SELECT pair_id, bytes // 2000 AS half FROM pair_v) GROUP BY pair_id HAVING count(DISTINCT half) > 1", "pair_v"))
def con03(spark, d):
    return K.paired_violations(B.pairs(spark, d).withColumn("half", F.floor(F.col("bytes") / 2000)), "pair_id", ["half"])


@query("con06_label_conditional", sql("SELECT CAST(sample_id AS VARCHAR) AS row_key, 'english_real' AS rule FROM manifest_v WHERE label = 0 AND real_source <> 'en'", "manifest_v"))
def con06(spark, d):
    return K.violations(B.manifest(spark, d), "sample_id", {"english_real": (F.col("label") == 1) | (F.col("real_source") == "en")})


@query("con08_score_vectors", sql("SELECT CAST(sample_id AS VARCHAR) AS row_key, 'range' AS rule FROM predictions_v WHERE NOT (score - 0.2 BETWEEN 0 AND 1)", "predictions_v"))
def con08(spark, d):
    return K.score_violations(B.predictions(spark, d).withColumn("score", F.col("score") - 0.2), "sample_id")


@query("jn01_manifest_lookup", sql("SELECT p.sample_id, p.condition, m.bytes FROM predictions_v p JOIN manifest_v m ON p.path = m.path", "predictions_v"))
def jn01(spark, d):
    found = B.predictions(spark, d).select("sample_id", "condition", "path")
    return U.look_up(found, B.manifest(spark, d).select("path", "bytes"), "path")[0].select("sample_id", "condition", "bytes")


ALIGN = """WITH a AS (SELECT {k}, count(*) AS n_a, max({v}) AS value_a FROM {x} GROUP BY ALL), b AS (SELECT {k}, count(*) AS n_b, max({w}) AS value_b FROM {y} GROUP BY ALL)
SELECT {k}, value_a, value_b, CASE WHEN n_a IS NULL THEN 'missing_a' WHEN n_b IS NULL THEN 'missing_b' WHEN n_a > 1 OR n_b > 1 THEN 'not_unique' ELSE 'ok' END AS verdict FROM a FULL JOIN b USING ({k})"""


@query("jn02_hash_alignment", sql(ALIGN.format(k="content_sha256", v="bytes", w="bytes", x="(SELECT * FROM split_v WHERE role = 'train')", y="(SELECT * FROM split_v WHERE role = 'eval')"), "split_v"))
def jn02(spark, d):
    rows = B.split(spark, d)
    return U.align(rows.filter("role = 'train'"), rows.filter("role = 'eval'"), ["content_sha256"], "bytes")


@query("jn03_dense_index", sql("SELECT condition, count(*) AS n_rows, min(i) AS low, max(i) AS high, count(DISTINCT i) AS n_distinct, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS dense FROM (SELECT condition, CASE WHEN idx % 2 = 0 THEN row_number() OVER (PARTITION BY condition ORDER BY sample_id) - 1 ELSE sample_id END AS i FROM predictions_v) GROUP BY condition", "predictions_v"))
def jn03(spark, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("condition").orderBy("sample_id")).cast("long") - 1
    return U.dense_index(B.predictions(spark, d).withColumn("i", F.when(F.col("idx") % 2 == 0, at).otherwise(F.col("sample_id"))), ["condition"], "i")


@query("jn04_two_candidates", sql(ALIGN.format(k="condition, sample_id, label, content_sha256", v="score", w="score_b", x="(SELECT * FROM predictions2_v WHERE real_source IS DISTINCT FROM 'en')", y="(SELECT * FROM predictions2_v WHERE generator IS DISTINCT FROM 'src1')"), "predictions2_v"))
def jn04(spark, d):
    rows = B.predictions2(spark, d)
    return U.align(rows.filter("NOT real_source <=> 'en'"), rows.filter("NOT generator <=> 'src1'").drop("score").withColumnRenamed("score_b", "score"), ["condition", "sample_id", "label", "content_sha256"], "score")


@query("jn06_reconcile_duplicates", sql("""SELECT content_sha256, count(*) AS n_rows, arg_min(label, sample_id) AS label, arg_min(score, sample_id) AS score, count(DISTINCT label) > 1 OR max(score) - min(score) > 1e-6 AS conflict FROM predictions_v WHERE condition = 'clean' GROUP BY 1""", "predictions_v"))
def jn06(spark, d):
    return U.reconcile(B.predictions(spark, d).filter("condition = 'clean'"), "content_sha256", "sample_id", "score")


@query("jn07_subset_scores", sql("""WITH one AS (SELECT content_sha256, arg_min(score, sample_id) AS score FROM predictions_v WHERE condition = 'clean' GROUP BY 1) SELECT s.sample_id, s.role, one.score FROM split_v s JOIN one USING (content_sha256) WHERE s.role = 'eval'""", "predictions_v", "split_v"))
def jn07(spark, d):
    one = jn06(spark, d).select("content_sha256", "score")
    return B.split(spark, d).filter("role = 'eval'").join(one, "content_sha256").select("sample_id", "role", "score")


@query("jn08_leakage", sql("SELECT 'path' AS identity, count(*) AS n_rows FROM split_v WHERE role = 'eval' AND path IN (SELECT path FROM split_v WHERE role = 'train') UNION ALL SELECT 'content_sha256', count(*) FROM split_v WHERE role = 'eval' AND content_sha256 IN (SELECT content_sha256 FROM split_v WHERE role = 'train')", "split_v"))
def jn08(spark, d):
    rows = B.split(spark, d)
    return U.leakage(rows.filter("role = 'train'"), rows.filter("role = 'eval'"), ["path", "content_sha256"])


@query("jn09_shared_identity", sql("WITH t AS (SELECT content_sha256 AS i FROM split_v WHERE role = 'train' UNION SELECT sha256(path) FROM split_v WHERE role = 'train') SELECT sample_id FROM split_v WHERE role = 'eval' AND content_sha256 NOT IN (SELECT i FROM t) AND sha256(path) NOT IN (SELECT i FROM t)", "split_v"))
def jn09(spark, d):
    rows = B.split(spark, d).withColumn("path_sha256", F.sha2("path", 256))
    return U.without_shared_identity(rows.filter("role = 'eval'"), rows.filter("role = 'train'").drop("sample_id"), "sample_id", ["content_sha256", "path_sha256"]).select("sample_id")


@query("jn11_path_or_hash_exclusion", sql("WITH l AS (SELECT CASE WHEN sample_id % 2 = 0 THEN path END AS path, CASE WHEN sample_id % 3 = 0 THEN content_sha256 END AS h FROM manifest_v WHERE sample_id % 6 <> 1) SELECT content_sha256, min(path) AS path FROM manifest_v WHERE path NOT IN (SELECT path FROM l WHERE path IS NOT NULL) AND content_sha256 NOT IN (SELECT h FROM l WHERE h IS NOT NULL) GROUP BY 1", "manifest_v"))
def jn11(spark, d):
    rows = B.manifest(spark, d)
    listed = rows.filter("sample_id % 6 <> 1").select(F.when(F.col("sample_id") % 2 == 0, F.col("path")).alias("path"), F.when(F.col("sample_id") % 3 == 0, F.col("content_sha256")).alias("content_sha256"))
    return U.path_or_hash_excluded(rows, listed).select("content_sha256", "path")


BITS = "list_reduce(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda a, b: a * 2 + b)"
HASHES = f"hash_v AS (SELECT vec_id, label, CAST({BITS} AS BIGINT) AS dh FROM embeddings)"


def hashes(spark, d):
    return B.vectors(spark, d).select("vec_id", "label", C.difference_hash(F.col("embedding")).alias("dh"))


@query("krn01_difference_hash", f"WITH {HASHES} SELECT vec_id, dh FROM hash_v")
def krn01(spark, d):
    return hashes(spark, d).select("vec_id", "dh")


BITS_A = "list_reduce(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) >= mean THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda a, b: a * 2 + b)"
AVERAGE = f"CAST(CASE WHEN {BITS_A} >= 9223372036854775808::HUGEINT THEN {BITS_A} - 18446744073709551616::HUGEINT ELSE {BITS_A} END AS BIGINT)"


@query("krn02_average_hash", "WITH m AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS mean FROM embeddings) SELECT vec_id, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) >= mean)) AS n_bits, " + AVERAGE + " AS ah FROM m")
def krn02(spark, d):
    return B.vectors(spark, d).select("vec_id", F.bit_count(C.average_hash(F.col("embedding"))).cast("long").alias("n_bits"), C.average_hash(F.col("embedding")).alias("ah"))


@query("jn12_hamming_pairs", f"WITH {HASHES} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.dh, b.dh)) AS distance FROM hash_v a JOIN hash_v b ON a.label < 5 AND b.label >= 5 AND bit_count(xor(a.dh, b.dh)) <= 16")
def jn12(spark, d):
    rows = hashes(spark, d)
    return N.hamming_pairs(rows.filter("label < 5"), rows.filter("label >= 5"), "vec_id", "dh", 16, 63)


@query("jn12_overlap_audit", f"""WITH {HASHES}, m AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS mean FROM embeddings), v AS (SELECT h.*, {AVERAGE} AS ah FROM hash_v h JOIN m USING (vec_id)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, a.dh AS da, b.dh AS db, a.ah AS aa, b.ah AS ab, bit_count(xor(a.dh, b.dh)) AS distance, bit_count(xor(a.ah, b.ah)) AS average_distance FROM v a CROSS JOIN v b WHERE bit_count(xor(a.dh, b.dh)) <= 4 AND bit_count(xor(a.ah, b.ah)) <= 4),
n AS (SELECT la, lb, da, db, aa, ab, distance, average_distance, min(a) AS a, min(b) AS b FROM p GROUP BY ALL), x AS (SELECT * FROM n ORDER BY distance, average_distance, a, b LIMIT 100)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE la <> lb) AS n_cross_label, (SELECT coalesce(string_agg(concat_ws(':', a, b, distance, average_distance), ',' ORDER BY distance, average_distance, a, b), '') FROM x) AS examples FROM p""")
def jn12_audit(spark, d):
    rows = hashes(spark, d).join(B.vectors(spark, d).select("vec_id", C.average_hash(F.col("embedding")).alias("ah")), "vec_id")
    return N.overlap_audit(rows, rows, "vec_id", "label", "dh", "ah")


@query("jn13_exact_overlap", sql("SELECT DISTINCT s.sample_id FROM split_v s JOIN split_v t ON s.content_sha256 = t.content_sha256 AND s.role = 'eval' AND t.role = 'train'", "split_v"))
def jn13(spark, d):
    rows = B.split(spark, d)
    return rows.filter("role = 'eval'").join(rows.filter("role = 'train'").select("content_sha256"), "content_sha256", "left_semi").select("sample_id")


@query("jn14_nearest_hash", f"WITH {HASHES}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.dh, b.dh)) AS distance FROM hash_v a JOIN hash_v b ON a.label < 5 AND b.label >= 5) SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM p WHERE distance <= 20) WHERE n = 1")
def jn14(spark, d):
    rows = hashes(spark, d)
    return N.nearest_hash(rows.filter("label < 5"), rows.filter("label >= 5"), "vec_id", "dh", 20, 63)


COSINE = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS place FROM p)"


def similar(spark, d, k):
    rows = B.vectors(spark, d)
    return cosine_top(rows.filter("label < 5"), rows.filter("label >= 5"), "vec_id", "embedding", k)


@query("jn15_cosine_top", f"WITH {COSINE} SELECT a, b, round(s, 6) AS similarity, place FROM t WHERE place <= 3")
def jn15(spark, d):
    return similar(spark, d, 3)


@query("jn15_search_work")
def jn15b(spark, d):
    rows = B.vectors(spark, d)
    return search_work(rows.filter("label < 5"), rows.filter("label >= 5"), "vec_id", "embedding", 3)


@query("agg35_matchability", f"WITH {COSINE} SELECT a AS vec_id, round(avg(round(s, 6)), 5) AS mean_similarity, min(round(s, 6)) AS min_similarity, max(round(s, 6)) AS max_similarity FROM t WHERE place <= 8 GROUP BY a")
def agg35(spark, d):
    return N.top_summary(similar(spark, d, 8), "vec_id")


@query("jn16_greedy_assignment")
def jn16(spark, d):
    rows = B.vectors(spark, d)
    return N.assignment(rows.filter("label < 5"), rows.filter("label >= 5"), "vec_id", "embedding", 20)


def label_means(rows):
    means = T.centroids(rows.filter("label < 5"), "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"].cast("float")).alias("embedding"))
    return means.select(F.col("label").cast("long").alias("vec_id"), "embedding")


@query("jn17_group_assignment")
def jn17(spark, d):
    rows = B.vectors(spark, d)
    return N.assignment(label_means(rows), rows.filter("label >= 5"), "vec_id", "embedding", 40, capacity=4)


ASSIGNED = "SELECT CAST(least({0} * l, r) AS BIGINT) AS n_pairs, CAST({1} AS BIGINT) AS left_used, CAST(least({0} * l, r) AS BIGINT) AS right_used, TRUE AS similarities_hold, TRUE AS within_bound FROM (SELECT count({2}) FILTER (label < 5) AS l, count(*) FILTER (label >= 5) AS r FROM embeddings)"


@query("jn16_auction_assignment", ASSIGNED.format(1, "least(l, r)", "*"))
def jn16_auction(spark, d):
    """Every row of the smaller side with one of the other, within n x 0.01 of the optimum by its own prices."""
    rows = B.vectors(spark, d)
    left, right = rows.filter("label < 5"), rows.filter("label >= 5")
    return A.assignment_properties(A.Assignment(left, right, "vec_id", "embedding"), left, right, "vec_id", "embedding")


@query("jn17_auction_slots", ASSIGNED.format(4, "l", "DISTINCT label"))
def jn17_auction(spark, d):
    """Four right rows for each label's mean, each right row once."""
    rows = B.vectors(spark, d)
    left, right = label_means(rows), rows.filter("label >= 5")
    return A.assignment_properties(A.Assignment(left, right, "vec_id", "embedding", capacity=4), left, right, "vec_id", "embedding")


@query("jn18_pair_assembly", sql("SELECT pair_id, sample_id, label, substr(sha256(concat('pair:', CAST(pair_id AS VARCHAR))), 1, 12) AS pair_name FROM pair_v", "pair_v"))
def jn18(spark, d):
    return B.pairs(spark, d).select("pair_id", "sample_id", "label", F.substring(F.sha2(F.concat(F.lit("pair:"), F.col("pair_id").cast("string")), 256), 1, 12).alias("pair_name"))


@query("jn19_condition_matrix", sql("SELECT m.sample_id, c.idx, c.condition FROM manifest_v m CROSS JOIN conditions_v c", "manifest_v", "conditions_v"))
def jn19(spark, d):
    return B.with_conditions(B.manifest(spark, d).select("sample_id")).select("sample_id", "idx", "condition")


@query("jn20_grid_gaps", sql("WITH g AS (SELECT g.* FROM grid_v g JOIN embeddings USING (vec_id) WHERE label <> 3), f AS (SELECT a.generator, b.prompt_id FROM (SELECT DISTINCT generator FROM g) a CROSS JOIN (SELECT DISTINCT prompt_id FROM g) b) SELECT f.generator, f.prompt_id, count(g.vec_id) AS n_rows FROM f LEFT JOIN g ON f.generator = g.generator AND f.prompt_id = g.prompt_id GROUP BY 1, 2 HAVING count(g.vec_id) <> 1", "grid_v"))
def jn20(spark, d):
    return T.grid_gaps(B.grid(spark, d).join(B.vectors(spark, d).filter("label <> 3").select("vec_id"), "vec_id", "left_semi"), "generator", "prompt_id")


@query("jn21_coverage", sql("""WITH c AS (SELECT DISTINCT generator FROM manifest_v WHERE label = 1), g AS (SELECT DISTINCT left(generator, 4) AS family, generator FROM quality_v WHERE label = 1)
SELECT family, count(*) AS n_names, count(*) FILTER (WHERE c.generator IS NULL) AS n_absent, count(*) FILTER (WHERE c.generator IS NULL) / CAST(count(*) AS DOUBLE) AS absent_share FROM g LEFT JOIN c USING (generator) GROUP BY family""", "manifest_v", "quality_v"))
def jn21(spark, d):
    gate = B.quality(spark, d).filter("label = 1").withColumn("family", F.substring("generator", 1, 4))
    return U.coverage(B.manifest(spark, d).filter("label = 1"), gate, "generator", "family")


@query("jn22_clean_noise_gates", sql("SELECT a.sample_id, a.score AS clean, b.score AS noise, round(b.score - a.score, 9) AS change FROM predictions_v a JOIN predictions_v b ON a.content_sha256 = b.content_sha256 AND a.label = b.label AND a.sample_id = b.sample_id AND a.condition = 'clean' AND b.condition = 'noise_sigma_0.10'", "predictions_v"))
def jn22(spark, d):
    rows = B.predictions(spark, d)
    side = lambda c, n: rows.filter(F.col("condition") == c).select("sample_id", "content_sha256", "label", F.col("score").alias(n))
    both = side("clean", "clean").join(side("noise_sigma_0.10", "noise"), ["sample_id", "content_sha256", "label"])
    return both.select("sample_id", "clean", "noise", F.round(F.col("noise") - F.col("clean"), 9).alias("change"))


@query("jn23_dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn23(spark, d):
    t = lambda n: B.table(spark, d, n)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("set01_union_manifests", sql("SELECT sample_id, role, NULL AS gate FROM split_v UNION ALL SELECT sample_id, NULL, 'quality' FROM quality_v", "split_v", "quality_v"))
def set01(spark, d):
    return U.union_manifests(B.split(spark, d).select("sample_id", "role"), B.quality(spark, d).select("sample_id", F.lit("quality").alias("gate"))).select("sample_id", "role", "gate")


@query("set03_key_intersection", sql("SELECT content_sha256 FROM split_v WHERE role = 'train' INTERSECT SELECT content_sha256 FROM split_v WHERE role = 'eval'", "split_v"))
def set03(spark, d):
    rows = B.split(spark, d)
    return rows.filter("role = 'train'").select("content_sha256").intersect(rows.filter("role = 'eval'").select("content_sha256"))


@query("set04_name_difference", sql("SELECT generator FROM quality_v WHERE label = 1 EXCEPT SELECT generator FROM manifest_v WHERE label = 1", "quality_v", "manifest_v"))
def set04(spark, d):
    return B.quality(spark, d).filter("label = 1").select("generator").subtract(B.manifest(spark, d).filter("label = 1").select("generator"))


@query("set05_label_collisions", sql("SELECT p, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM (SELECT content_sha256 AS p, label FROM manifest_v UNION ALL SELECT content_sha256, label FROM quality_v) GROUP BY p HAVING count(DISTINCT label) > 1", "manifest_v", "quality_v"))
def set05(spark, d):
    return U.collisions(B.manifest(spark, d).unionByName(B.quality(spark, d)).select(F.col("content_sha256").alias("p"), "label"), "p")


# The wide row of metrics that rules read: the candidate ``score`` and, with other_, ``score_b``.
METRICS_SQL = "WITH " + POOLED_SQL + """, both_v AS (SELECT idx, condition, view, label, generator, real_source, 'score' AS candidate, score AS value FROM pooled UNION ALL SELECT idx, condition, view, label, generator, real_source, 'score_b', score_b FROM pooled),
by_view AS (WITH """ + auc_sql("both_v", ["candidate", "view"], "value")[5:] + "), by_condition AS (WITH " + auc_sql("both_v", ["candidate", "condition"], "value")[5:] + """),
by_group AS (""" + grouped_sql("both_v", ["candidate", "view"], "SELECT * FROM grp", "value") + """),
means AS (SELECT candidate, avg(value) FILTER (WHERE label = 0) AS real_mean, avg(value) FILTER (WHERE label = 1) AS fake_mean FROM both_v WHERE condition = 'noise_sigma_0.10' GROUP BY 1),
flat AS (SELECT v.candidate, max(v.auc) FILTER (WHERE view = 'clean') AS clean, max(v.auc) FILTER (WHERE view = 'pooled') AS pooled FROM by_view v GROUP BY 1),
cond AS (SELECT candidate, min(auc) AS worst_condition, max(auc) FILTER (WHERE condition = 'noise_sigma_0.10') AS noise FROM by_condition GROUP BY 1),
grps AS (SELECT candidate, min(auc) FILTER (WHERE level = 'generator' AND view = 'clean') AS worst_generator, min(auc) FILTER (WHERE level = 'source' AND view = 'clean') AS worst_source, min(auc) FILTER (WHERE level = 'pair' AND view = 'clean') AS worst_pair,
  min(auc) FILTER (WHERE level = 'generator' AND view = 'pooled') AS pooled_worst_generator, min(auc) FILTER (WHERE level = 'pair' AND view = 'pooled') AS pooled_worst_pair FROM by_group GROUP BY 1),
m AS (SELECT f.candidate, clean, pooled, 0.5 * clean + 0.5 * pooled AS official, worst_condition, noise, worst_generator, worst_source, worst_pair, pooled_worst_generator, pooled_worst_pair, round(real_mean, 9) AS noise_real_mean, round(fake_mean, 9) AS noise_fake_mean FROM flat f JOIN cond USING (candidate) JOIN grps USING (candidate) JOIN means USING (candidate))
"""
METRIC_NAMES = ("clean", "pooled", "official", "worst_condition", "noise", "worst_generator", "worst_source", "worst_pair", "pooled_worst_generator", "pooled_worst_pair", "noise_real_mean", "noise_fake_mean")


def metric_rows(spark, d):
    """One wide row of metrics for each candidate."""
    both = M.unpivot_scores(M.pooled(B.predictions2(spark, d)), ["score", "score_b"])
    view = M.auc(both, ["candidate", "view"])
    pick = lambda c, v: F.max(F.when(F.col("view") == v, F.col(c)))
    flat = view.groupBy("candidate").agg(pick("auc", "clean").alias("clean"), pick("auc", "pooled").alias("pooled")).withColumn("official", 0.5 * F.col("clean") + 0.5 * F.col("pooled"))
    condition = M.auc(both, ["candidate", "condition"]).groupBy("candidate").agg(F.min("auc").alias("worst_condition"), F.max(F.when(F.col("condition") == "noise_sigma_0.10", F.col("auc"))).alias("noise"))
    low = lambda level, v: F.min(F.when((F.col("level") == level) & (F.col("view") == v), F.col("auc")))
    groups = M.grouped_auc(both, ["candidate", "view"]).groupBy("candidate").agg(low("generator", "clean").alias("worst_generator"), low("source", "clean").alias("worst_source"), low("pair", "clean").alias("worst_pair"), low("generator", "pooled").alias("pooled_worst_generator"), low("pair", "pooled").alias("pooled_worst_pair"))
    means = M.class_means(both.filter("condition = 'noise_sigma_0.10'"), ["candidate"]).select("candidate", F.col("real_mean").alias("noise_real_mean"), F.col("fake_mean").alias("noise_fake_mean"))
    return flat.join(condition, "candidate").join(groups, "candidate").join(means, "candidate")


def compared(spark, d):
    """The metrics of ``score`` with those of ``score_b`` beside them as other_*."""
    return side_by_side(metric_rows(spark, d), METRIC_NAMES)


def side_by_side(rows, names):
    """The one row of ``score``'s metrics and, as other_*, those of ``score_b``, from one pass over the two rows."""
    of = lambda candidate, name: F.max(F.when(F.col("candidate") == candidate, F.col(name)))
    wide = rows.agg(*[of("score", n).alias(n) for n in names], *[of("score_b", n).alias(f"other_{n}") for n in names])
    return wide.select(F.lit("score").alias("candidate"), *wide.columns)


def decision_sql(rules) -> str:
    from_ = METRICS_SQL + ", c AS (SELECT a.*, " + ", ".join(f"b.{n} AS other_{n}" for n in METRIC_NAMES) + " FROM m a CROSS JOIN m b WHERE a.candidate = 'score' AND b.candidate = 'score_b')\n"
    parts = []
    for name, left, op, right, number in rules:
        bound = f"{right or '0.0::DOUBLE'} + ({number})::DOUBLE"
        parts.append(f"SELECT candidate, '{name}' AS check_name, {left} AS observed, {bound} AS bound, coalesce({left} {op} {bound}, false) AS passes FROM c")
    return sql(from_ + "\nUNION ALL ".join(parts), "predictions2_v")


def _rule_query(number: str, name: str):
    @query(f"dec{number}_{name}", decision_sql(D.RULES[name]))
    def run(spark, d):
        return D.decide(compared(spark, d), ["candidate"], D.RULES[name])

    return run


for _number, _name in (("01", "arbitration"), ("02", "promotion"), ("05", "community"), ("06", "arbitration_gate"), ("12", "ensemble"), ("12b", "ensemble_holdout")):
    _rule_query(_number, _name)


@query("dec04_clean_bands", sql(METRICS_SQL + "SELECT candidate, clean, CASE WHEN clean < 0.65 THEN 'reject' WHEN clean < 0.80 THEN 'warning' ELSE 'useful' END AS band, clean >= 0.80 AND worst_condition >= 0.60 AS passes FROM m", "predictions2_v"))
def dec04(spark, d):
    rows = metric_rows(spark, d)
    return rows.select("candidate", "clean", D.bands(F.col("clean"), (0.65, "reject"), (0.80, "warning"), rest="useful").alias("band"), ((F.col("clean") >= 0.80) & (F.col("worst_condition") >= 0.60)).alias("passes"))


@query("dec14_severity_bands", sql(METRICS_SQL + "SELECT candidate, CASE WHEN noise < 0.5 THEN 'inversion' WHEN noise < 0.7 THEN 'severe' WHEN noise < 0.8 THEN 'material' ELSE 'specific' END AS band, clean < 0.8 AS clean_low, noise_real_mean > noise_fake_mean AS inverted FROM m", "predictions2_v"))
def dec14(spark, d):
    band = D.bands(F.col("noise"), (0.5, "inversion"), (0.7, "severe"), (0.8, "material"), rest="specific")
    return metric_rows(spark, d).select("candidate", band.alias("band"), (F.col("clean") < 0.8).alias("clean_low"), (F.col("noise_real_mean") > F.col("noise_fake_mean")).alias("inverted"))


@query("dec01b_selected_default", sql(decision_sql(D.RULES["arbitration"])[0:0] + METRICS_SQL + ", c AS (SELECT a.*, b.official AS oo, b.clean AS oc, b.worst_condition AS ow FROM m a CROSS JOIN m b WHERE a.candidate = 'score' AND b.candidate = 'score_b') SELECT CASE WHEN official >= oo + 0.02 AND clean >= oc - 0.005 AND worst_condition >= ow - 0.03 AND clean >= 0.80 AND official >= 0.75 THEN 'first' ELSE 'blend' END AS selected FROM c", "predictions2_v"))
def dec01b(spark, d):
    return D.choose(D.decide(compared(spark, d), ["candidate"], D.RULES["arbitration"]), "first", "blend")


RANKED = METRICS_SQL + "SELECT candidate, clean, least(worst_generator, worst_source, worst_pair) AS floor, least(worst_generator, worst_source, worst_pair) < 0.5 AS veto FROM m"


@query("top05_candidate_ranking", sql(RANKED, "predictions2_v"))
def top05(spark, d):
    return D.rank_candidates(metric_rows(spark, d), "candidate").select("candidate", "clean", "floor", "veto")


@query("agg33_harmonic_mean", sql(METRICS_SQL + "SELECT candidate, round(2 / (1 / clean + 1 / f), 9) AS harmonic_mean FROM (SELECT candidate, clean, nullif(least(worst_generator, worst_source, worst_pair), 0) AS f FROM m)", "predictions2_v"))
def agg33(spark, d):
    return D.rank_candidates(metric_rows(spark, d), "candidate").select("candidate", F.round("harmonic_mean", 9).alias("harmonic_mean"))


WEIGHTS = (0.90, 0.75, 0.50)

#: The condition that stands for the content gate.
CONTENT = "jpeg_q90"


def weight_grid(spark, d):
    both = B.predictions2(spark, d).filter(F.col("condition").isin("clean", CONTENT))
    return both.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in WEIGHTS]))).withColumn("score", F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("score_b"))


GRID_SQL = "WITH wg AS (SELECT p.*, w.weight, w.weight * score + (1 - w.weight) * score_b AS value FROM predictions2_v p CROSS JOIN (VALUES (0.90::DOUBLE), (0.75), (0.50)) w(weight) WHERE condition IN ('clean', 'jpeg_q90')), g AS (" + grouped_sql("wg", ["weight", "condition"], "SELECT * FROM grp", "value") + "), r AS (SELECT weight, max(auc) FILTER (WHERE level = 'all' AND condition = 'clean') AS clean, min(auc) FILTER (WHERE level = 'pair' AND condition = 'clean') AS worst_pair, max(auc) FILTER (WHERE level = 'all' AND condition <> 'clean') AS content_clean, min(auc) FILTER (WHERE level = 'pair' AND condition <> 'clean') AS content_pair FROM g GROUP BY weight)\n"


def grid_metrics(spark, d):
    low = lambda level, c, f: f(F.when((F.col("level") == level) & (F.col("condition") == c), F.col("auc")))
    aggs = [low("all", c, F.max).alias(a) for c, a in (("clean", "clean"), (CONTENT, "content_clean"))] + [low("pair", c, F.min).alias(a) for c, a in (("clean", "worst_pair"), (CONTENT, "content_pair"))]
    return M.grouped_auc(weight_grid(spark, d), ["weight", "condition"]).groupBy("weight").agg(*aggs)


@query("dec13_weight_grid", sql(GRID_SQL + "SELECT weight, clean, worst_pair, content_clean, content_pair, clean >= 0.979830 AND worst_pair >= 0.862510 AND content_clean >= 0.992353 AND content_pair >= 0.959759 AS passes FROM r", "predictions2_v"))
def dec13(spark, d):
    rows = grid_metrics(spark, d)
    checks = D.decide(rows, ["weight"], D.RULES["weight_grid"])
    return rows.join(D.verdict(checks, ["weight"]), "weight").select("weight", "clean", "worst_pair", "content_clean", "content_pair", F.col("passes_all").alias("passes"))


@query("top06_best_passing", sql(GRID_SQL + "SELECT weight, clean, worst_pair FROM r WHERE clean >= 0.5 ORDER BY clean DESC, worst_pair DESC, weight DESC LIMIT 1", "predictions2_v"))
def top06(spark, d):
    rows = grid_metrics(spark, d)
    checks = D.decide(rows, ["weight"], (("clean", "clean", ">=", None, 0.5),))
    return D.best_passing(rows, checks, ["weight"], F.desc("clean"), F.desc("worst_pair"), F.desc("weight")).select("weight", "clean", "worst_pair")
