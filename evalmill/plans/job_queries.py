"""Queries on the composed jobs that build and evaluate gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import metrics as M
from evalmill.operators import sample as P
from evalmill.plans import bindings as B
from evalmill.plans import jobs as J
from evalmill.plans.bindings import sql
from evalmill.plans.metric_queries import auc_sql
from evalmill.plans.registry import query
from evalmill.plans.stat_queries import rank_sql


def dealt_sql(fakes: str, reals: str, seed: int, name: str) -> str:
    """Views ``r``, ``g``, ``dealt``: as many rows of ``reals`` as ``fakes`` has, dealt equally over the sources."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY real_source ORDER BY {rank_sql(seed, name, 'sample_id')}) AS place FROM {reals}),
g AS (SELECT real_source, row_number() OVER (ORDER BY real_source) - 1 AS i, count(*) OVER () AS k, (SELECT count(*) FROM {fakes}) AS n FROM (SELECT DISTINCT real_source FROM r)),
dealt AS (SELECT r.* EXCLUDE (place) FROM r JOIN g ON r.real_source = g.real_source WHERE place <= n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END)"""


USED = "content_sha256 IN (SELECT content_sha256 FROM split_v WHERE role = 'train')"


def _sides(spark, d):
    rows = B.split(spark, d)
    return rows.filter("role = 'eval'").drop("role"), rows.filter("role = 'train'").drop("role")


@query("job02_paired_control", sql(f"""WITH fresh AS (SELECT * FROM split_v WHERE role = 'eval' AND NOT {USED}), ranked AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY {rank_sql(8, 'paired', 'sample_id')}) AS n FROM fresh WHERE label = 1 AND generator <> 'src1'),
fakes AS (SELECT * EXCLUDE (n) FROM ranked WHERE n <= 2), reals AS (SELECT * FROM fresh WHERE label = 0), {dealt_sql('fakes', 'reals', 8, 'paired')} SELECT sample_id, label FROM fakes UNION ALL SELECT sample_id, label FROM dealt""", "split_v"))
def job02(spark, d):
    pool, used = _sides(spark, d)
    return J.paired_control(pool, used, "src1", 2, 8).select("sample_id", "label")


@query("job06_canonical_view")
def job06(spark, d):
    return J.canonical_view(B.vectors(spark, d), "vec_id", "embedding", (8, 8)).select("vec_id", "derived_sha256", "n_rows", "n_labels")


@query("job10_matched_gate", sql(f"""WITH q AS (SELECT format, size_bucket, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS quota FROM meta_v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY format, size_bucket, label ORDER BY {rank_sql(10, 'matched', 'sample_id')}) AS place FROM meta_v)
SELECT sample_id, label, format, size_bucket FROM r JOIN q USING (format, size_bucket) WHERE place <= quota""", "meta_v"))
def job10(spark, d):
    return P.matched_strata(B.meta(spark, d), ["format", "size_bucket"], P.rank_of(10, "matched", "sample_id")).select("sample_id", "label", "format", "size_bucket")


@query("job11_breadth_gate", sql(f"""WITH fakes AS (SELECT * FROM split_v WHERE role = 'eval' AND label = 1), reals AS (SELECT * FROM split_v WHERE role = 'eval' AND label = 0), {dealt_sql('fakes', 'reals', 11, 'breadth')}, gate AS (SELECT * FROM fakes UNION ALL SELECT * FROM dealt)
SELECT sample_id, label FROM gate WHERE NOT {USED}""", "split_v"))
def job11(spark, d):
    held, prior = _sides(spark, d)
    return J.breadth_gate(held.filter("label = 1"), held.filter("label = 0"), prior, ["content_sha256"], 11).select("sample_id", "label")


@query("job12_equal_source_gate", sql(f"""WITH fakes AS (SELECT * FROM split_v WHERE role = 'eval' AND label = 1), reals AS (SELECT * FROM split_v WHERE role = 'eval' AND label = 0), {dealt_sql('fakes', 'reals', 12, 'audit')}, gate AS (SELECT * FROM fakes UNION ALL SELECT * FROM dealt)
SELECT sample_id, label, count(*) OVER (PARTITION BY content_sha256) > 1 AS repeated, {USED} AS in_training FROM gate""", "split_v"))
def job12(spark, d):
    held, training = _sides(spark, d)
    return J.equal_source_gate(held.filter("label = 1"), held.filter("label = 0"), training, 12).select("sample_id", "label", "repeated", "in_training")


@query("job14_class_balanced_gate", sql("""WITH listed AS (SELECT path, content_sha256 FROM manifest_v WHERE sample_id % 7 = 0), fresh AS (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY path) AS n FROM manifest_v WHERE path NOT IN (SELECT path FROM listed) AND content_sha256 NOT IN (SELECT content_sha256 FROM listed)),
placed AS (SELECT sample_id, label, coalesce(generator, real_source) AS kind, row_number() OVER (PARTITION BY label, coalesce(generator, real_source) ORDER BY content_sha256) AS place FROM fresh WHERE n = 1) SELECT sample_id, label, kind, CASE WHEN place <= 3 THEN 'gate' ELSE 'repair' END AS role FROM placed WHERE place <= 6""", "manifest_v"))
def job14(spark, d):
    rows = B.manifest(spark, d).withColumn("kind", C.group_key(F.col("label"), F.col("generator"), F.col("real_source")))
    listed = rows.filter("sample_id % 7 = 0").select("path", "content_sha256")
    return J.class_balanced_gate(rows, listed, "kind", 3, F.col("content_sha256")).select("sample_id", "label", "kind", "role")


@query("job15_label_balanced_sample", sql(f"""WITH fresh AS (SELECT content_sha256, min(sample_id) AS sample_id FROM split_v WHERE role = 'eval' AND NOT {USED} GROUP BY 1), r AS (SELECT f.sample_id, m.label, row_number() OVER (PARTITION BY m.label ORDER BY {rank_sql(15, 'route', 'f.sample_id')}) AS place FROM fresh f JOIN manifest_v m ON f.sample_id = m.sample_id)
SELECT sample_id, label, place FROM r WHERE place <= 30""", "split_v", "manifest_v"))
def job15(spark, d):
    held, used = _sides(spark, d)
    return J.label_balanced_sample(held, used, 30, 15, "route").select("sample_id", "label", "place")


def _gate_auc(name: str) -> str:
    return auc_sql(name, [])[5:]


@query("job24_gate_evaluators", sql(f"""WITH clean AS (SELECT * FROM predictions_v WHERE condition = 'clean'), noisy AS (SELECT * FROM predictions_v WHERE condition LIKE 'noise%'), a AS (WITH {_gate_auc('clean')}), b AS (WITH {_gate_auc('noisy')})
SELECT 'clean' AS gate, 'auc' AS check_name, auc AS observed, 0.6::DOUBLE AS bound, auc >= 0.6 AS passes FROM a UNION ALL SELECT 'noise', 'auc', auc, 0.55::DOUBLE, auc >= 0.55 FROM b""", "predictions_v"))
def job24(spark, d):
    spec = lambda floor: J.GateSpec(valid=lambda rows: rows.filter("score IS NULL OR score NOT BETWEEN 0 AND 1"), metrics=lambda rows: M.auc(rows).select("auc"), rules=(("auc", "auc", ">=", None, floor),))
    gates = {"clean": (F.col("condition") == "clean", spec(0.6)), "noise": (F.col("condition").startswith("noise"), spec(0.55))}
    return J.evaluate_gates(B.predictions(spark, d), gates).select("gate", "check_name", "observed", "bound", "passes")
