"""Small literal inputs with answers worked out by hand, brute-force comparisons and error cases."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import contracts, curate, decide, errors, metrics, neighbours, order, sample, score, stats
from evalmill.plans import jobs
from evalmill.sources import images, manifests, sinks

ROWS = "sample_id string, label int, generator string, real_source string, score double, path string"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([("r1", 0, None, "camera-a", 0.1, "r1"), ("r2", 0, None, "camera-b", 0.8, "r2"), ("f1", 1, "gan", None, 0.9, "f1"), ("f2", 1, "diffusion", None, 0.2, "f2")], ROWS)


def one(df):
    return df.first().asDict()


def test_official_metrics(spark):
    rows = [("clean", y, s) for y, s in zip((0, 0, 1, 1), (0.1, 0.2, 0.8, 0.9))] + [("noise", y, s) for y, s in zip((0, 0, 1, 1), (0.1, 0.7, 0.6, 0.8))]
    got = one(metrics.official(spark.createDataFrame(rows, "condition string, label int, score double")))
    assert (got["clean_auc"], got["pooled_auc"], got["official_score"]) == (1.0, 0.75, 0.875)


def test_groups(four):
    got = {(r["level"], r["generator"], r["real_source"]): r["auc"] for r in metrics.grouped_auc(four, []).collect()}
    assert got["pair", "gan", "camera-a"] == 1.0 and got["pair", "diffusion", "camera-b"] == 0.0
    low = one(metrics.worst(metrics.grouped_auc(four, []), []))
    assert low == {"worst_generator_auc": 0.5, "worst_source_auc": 0.5, "worst_pair_auc": 0.0}
    right = {r["group_name"]: r["n_right"] for r in metrics.rates(four, [], C.group_key(F.col("label"), F.col("generator"), F.col("real_source"))).collect()}
    assert right == {"gan": 1, "diffusion": 0, "camera-a": 1, "camera-b": 0}


@pytest.mark.parametrize("seed", range(4))
def test_auc_is_the_pairwise_count(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for ranges in (1, 7, 64):
        assert one(metrics.auc(spark.createDataFrame(rows, "label int, score double"), ranges=ranges))["auc"] == pytest.approx(want, abs=1e-12)


def test_one_label_has_no_auc(spark):
    assert one(metrics.auc(spark.createDataFrame([(1, 0.5)], "label int, score double")))["auc"] is None


def test_ranked_errors(spark):
    rows = spark.createDataFrame([(0, 0.9, "real-a"), (0, 0.2, "real-b"), (1, 0.1, "fake-a"), (1, 0.8, "fake-b")], "label int, score double, path string")
    got = {r["list_name"]: r["path"] for r in errors.ranked_errors(rows, [], 1).collect()}
    assert got == {"top_real": "real-a", "bottom_fake": "fake-a", "false_positive": "real-a", "false_negative": "fake-a"}
    total = one(errors.error_summary(rows))
    assert (total["n_fp"], total["n_fn"], total["balanced_accuracy"]) == (1, 1, 0.5)


def test_threshold(spark):
    rows = spark.createDataFrame([(0, 0.2, "a"), (0, 0.4, "b"), (1, 0.6, "x"), (1, 0.8, "y")], "label int, score double, g string")
    swept = errors.threshold_sweep(rows, F.col("g"))
    best = one(errors.select_threshold(swept))
    assert best == {"threshold": 0.5, "min_recall": 1.0, "balanced_accuracy": 1.0}
    got = {r["threshold"]: r["min_recall"] for r in swept.collect()}
    for t, low in got.items():
        assert low == min(float(s < t) if y == 0 else float(s >= t) for y, s in ((0, 0.2), (0, 0.4), (1, 0.6), (1, 0.8)))


def test_variance_shares(spark):
    rows = spark.createDataFrame([("easy", 0.1), ("easy", 0.2), ("hard", 0.7), ("hard", 0.8)], "real_source string, score double")
    assert one(stats.between_share(rows, [], "real_source", "score"))["share"] == 0.972972973
    cells = spark.createDataFrame([(p, g, 0.2 * p + (0.2 if g == "b" else 0)) for p in (1, 2) for g in "ab"], "prompt_id int, generator string, score double")
    assert one(stats.balanced_effects(cells, "prompt_id", "generator", "score")) == {"prompt_id_share": 0.5, "generator_share": 0.5, "rest_share": 0.0}


def test_coverage(spark):
    train = spark.createDataFrame([("old",)], "generator string")
    gate = spark.createDataFrame([("new", "LatDiff")], "generator string, family string")
    assert one(curate.coverage(train, gate, "generator", "family")) == {"family": "LatDiff", "n_names": 1, "n_absent": 1, "absent_share": 1.0}


def test_candidate_ranking(spark):
    kind = "name string, clean double, worst_generator double, worst_source double, worst_pair double"
    got = [r["name"] for r in decide.rank_candidates(spark.createDataFrame([("a", 0.99, 0.9, 0.9, 0.49), ("b", 0.85, 0.65, 0.65, 0.65)], kind), "name").collect()]
    assert got == ["b", "a"]


def test_arbitration(spark):
    kind = "clean double, official double, worst_condition double, other_clean double, other_official double, other_worst_condition double"
    for worst, want in ((0.81, "first"), (0.79, "blend")):
        row = spark.createDataFrame([(0.91, 0.91, worst, 0.91, 0.86, 0.83)], kind)
        assert one(decide.choose(decide.decide(row, [], decide.RULES["arbitration"]), "first", "blend"))["selected"] == want


def test_semantic_floors(spark):
    kind = "clean double, paired_accuracy double, worst_prompt double, official double, worst_condition double"
    for prompt, want in ((0.56, True), (0.54, False)):
        row = spark.createDataFrame([(0.71, 0.66, prompt, 0.66, 0.56)], kind)
        assert one(decide.verdict(decide.decide(row.withColumn("k", F.lit(1)), ["k"], decide.RULES["semantic"]), ["k"]))["passes_all"] is want
    missing = spark.createDataFrame([(None, 0.66, 0.56, 0.66, 0.56)], kind)
    assert one(decide.verdict(decide.decide(missing.withColumn("k", F.lit(1)), ["k"], decide.RULES["semantic"]), ["k"]))["n_failed"] == 1


def test_weights(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "x"), (1, "y"), (1, "y")], "label int, g string")
    mass = {r["g"]: r["m"] for r in sample.balanced_weights(rows, F.col("g")).groupBy("g").agg(F.round(F.sum("weight"), 9).alias("m")).collect()}
    assert mass == {"a": 0.5, "b": 0.5, "x": 0.5, "y": 0.5}
    many = [(0, f"r{i}", "real") for i in range(2) for _ in range(3)] + [(1, f"l{i}", "legacy") for i in range(3) for _ in range(4)] + [(1, f"n{i}", "frontier") for i in range(18) for _ in range(2)]
    blocks = sample.block_weights(spark.createDataFrame(many, "label int, g string, b string"), F.col("b"), F.col("g"), {"real": 1.0, "legacy": 0.85, "frontier": 0.15})
    got = {r["block"]: r["m"] for r in blocks.groupBy("block").agg(F.round(F.sum("weight"), 9).alias("m")).collect()}
    assert got == {"real": 0.5, "legacy": 0.425, "frontier": 0.075}


def test_rank_windows_are_disjoint_and_ignore_order(spark):
    rows = [(c, f"{c}-{i}") for c in range(100) for i in range(4)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "label int, h string")
    a, b = ({r["h"] for r in sample.rank_window(df.repartition(n), ["label"], s, 2, F.sha2("h", 256)).collect()} for s, n in ((0, 1), (2, 7)))
    assert len(a) == len(b) == 200 and not a & b
    assert a == {r["h"] for r in sample.rank_window(df.repartition(64), ["label"], 0, 2, F.sha2("h", 256)).collect()}


def test_weighted_draws_follow_the_weights(spark):
    rows = spark.range(4000).withColumn("weight", F.when(F.col("id") < 1000, 3.0).otherwise(1.0))
    got = sample.with_replacement(rows, "weight", 12_000, 5, "id").groupBy(F.col("id") < 1000).agg(F.avg("times")).collect()
    means = {r[0]: r[1] for r in got}
    assert means[True] == pytest.approx(6, rel=0.1) and means[False] == pytest.approx(2, rel=0.1)


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_hamming_pairs_are_complete(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    planted = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 5))) for b in base] + base[:5]
    left, right = (spark.createDataFrame(list(enumerate(x)), "k long, h long") for x in (base, planted))
    got = {(r["a"], r["b"], r["distance"]) for r in neighbours.hamming_pairs(left, right, "k", "h", radius).collect()}
    assert got == {(i, j, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in enumerate(base) for j, b in enumerate(planted) if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    assert neighbours.hamming_pairs(left, right, "k", "h", radius).count() == len(got)


def test_greedy_assignment(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        m = rng.random((4, 6)).round(3)
        rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(6)], "a long, b long, similarity double")
        got = neighbours.greedy_assignment(rows).collect()
        assert len(got) == 4 and len({r["b"] for r in got}) == 4 and len({r["a"] for r in got}) == 4
        best = max(sum(m[i, j] for i, j in enumerate(p)) for p in permutations(range(6), 4))
        assert 0.5 * best <= sum(r["similarity"] for r in got) <= best + 1e-9
    two = neighbours.greedy_assignment(rows, capacity=1 + 0)
    assert {r["a"] for r in two.collect()} == {0, 1, 2, 3}
    many = neighbours.greedy_assignment(rows.filter("a < 2"), capacity=2).groupBy("a").count().collect()
    assert {r["count"] for r in many} == {2}


def test_matching_uses_up_a_side(spark):
    rng = np.random.default_rng(5)
    near = [[1.0, 0.001 * i, 0.0] for i in range(6)]
    fakes = [[1.0, 0.0, 0.0]] * 9 + near
    reals = [[float(x) for x in v] for v in rng.random((14, 3))] + [[1.0, 0.1, 0.0]] * 4
    rows = [(i, v, 1) for i, v in enumerate(fakes)] + [(100 + i, v, 0) for i, v in enumerate(reals)] + [(900, None, 0), (901, [float("nan"), 0.0, 0.0], 1)]
    got = jobs.matched_pairs(spark.createDataFrame(rows, "id long, v array<double>, label int"), "id", "v").collect()
    for label, many in ((1, set(range(15))), (0, None)):
        ids = [r["id"] for r in got if r["label"] == label]
        assert len(ids) == len(set(ids)) == 15 and (many is None or set(ids) == many)
    assert len({r["pair_id"] for r in got}) == 15
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and i < 900}
    ends = {}
    for r in got:
        ends.setdefault(r["pair_id"], {})[r["label"]] = (r["id"], r["similarity"])
    assert all(e[1][1] == pytest.approx(float(unit[e[1][0]] @ unit[e[0][0]]), abs=2e-6) for e in ends.values())
    left = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0])], "id long, v array<double>")
    right = spark.createDataFrame(list(enumerate(reals)), "id long, v array<double>")
    assert {r["a"]: r["count"] for r in neighbours.assignment(left, right, "id", "v", 2, capacity=4).groupBy("a").count().collect()} == {7: 4, 8: 4}


def test_unit_clusters_are_fitted_on_all_rows(spark):
    ranked = [r["id"] for r in spark.range(6000).orderBy(C.hash_rank(5, "centres", F.col("id")), "id").collect()]
    rng, few = np.random.default_rng(3), set(ranked[-30:])  # a small cluster outside the 4,096 lowest ranks
    rows = [(i, [float(x) for x in rng.normal(0, 0.02, 3) + ([0, 1, 0] if i in few else [1, 0, 0])]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in score.unit_clusters(df, "id", "v", 2, 5).collect()}
    assert len(got) == 6000 and {got[i] for i in few}.isdisjoint(got[i] for i in got if i not in few)
    assert got == {r["id"]: r["cluster"] for r in score.unit_clusters(df.repartition(7), "id", "v", 2, 5).collect()}


def test_ranking_of_all_groups_has_no_limit(spark):
    rows = spark.range(1500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("g"), F.when(F.col("id") > 3, (F.col("id") % 700).cast("double")).alias("v"))
    got = sorted(errors.lowest(rows, [], "v", None, "g").collect(), key=lambda r: r["place"])
    want = sorted(rows.collect(), key=lambda r: (r["v"] is None, r["v"] or 0.0, r["g"]))
    assert [(r["place"], r["g"]) for r in got] == [(i, r["g"]) for i, r in enumerate(want, 1)]


def test_shared_identity(spark):
    kind = "k string, sha256 string, image_sha256 string, source_image_sha256 string"
    gate = spark.createDataFrame([("keep", "1", None, None), ("source", None, "2", "9"), ("canonical", "8", None, None)], kind)
    prior = spark.createDataFrame([("p", "9", None, None), ("q", None, "8", None)], kind).drop("k")
    assert [r["k"] for r in curate.without_shared_identity(gate, prior, "k", ["sha256", "image_sha256", "source_image_sha256"]).collect()] == ["keep"]


def test_routing(spark):
    rows = spark.createDataFrame([(0.01, 0.2, 0.6, 0.9), (0.055, 0.3, 0.7, 0.1), (0.10, 0.4, 0.8, 0.2)], "n double, a double, b double, s double")
    got = rows.select(F.round(C.routed(F.col("n"), F.col("a"), F.col("b"), F.col("s")), 9).alias("r"), F.round(C.blend(F.col("a"), F.col("b"), 0.75), 9).alias("g")).collect()
    assert [r["r"] for r in got] == [0.3, 0.1, 0.2] and [r["g"] for r in got] == [0.3, 0.4, 0.5]


def test_reconcile(spark):
    rows = spark.createDataFrame([("x", 0, 1, 0.7), ("x", 1, 1, 0.7), ("y", 2, 1, 0.7), ("y", 3, 1, 0.8)], "h string, i int, label int, score double")
    got = {r["h"]: r["conflict"] for r in curate.reconcile(rows, "h", "i", "score").collect()}
    assert got == {"x": False, "y": True}


def test_exclusions(spark):
    rows, listed = spark.createDataFrame([("keep",), ("remove",)], "h string"), spark.createDataFrame([("remove",), ("absent",)], "h string")
    kept, absent = curate.exclude(rows, listed, "h")
    assert [r["h"] for r in kept.collect()] == ["keep"] and [r["h"] for r in absent.collect()] == ["absent"]


def test_inversion(spark):
    rows = spark.createDataFrame([(0, 0.9)] * 1000 + [(1, 0.1)] * 288, "label int, score double")
    assert one(metrics.auc(rows))["auc"] == 0.0 and one(metrics.class_means(rows))["inverted"] is True
    assert one(stats.distribution(rows.filter("label = 0"), [], "score"))["share_from_half"] == 1.0


def test_contracts(spark):
    rows = spark.createDataFrame([("a", 0, 0.5), ("b", 2, float("nan")), ("c", 1, None)], "k string, label int, score double")
    got = {(r["row_key"], r["rule"]) for r in contracts.score_violations(rows, "k").collect()}
    assert got == {("b", "label"), ("b", "finite"), ("b", "range"), ("c", "finite"), ("c", "range")}
    with pytest.raises(contracts.ContractError):
        contracts.demand_none(contracts.score_violations(rows, "k"))
    contracts.demand_none(contracts.score_violations(rows.filter("k = 'a'"), "k"))
    with pytest.raises(ValueError):
        jobs.evaluate_gate(rows, jobs.GateSpec(valid=lambda r: r.filter("score IS NULL"), metrics=metrics.auc, rules=()))


def test_global_index(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    got = sorted((r["v"], r["i"]) for r in order.with_index(rows, "i", "v").collect())
    assert [i for _, i in got] == list(range(500))


def test_noise_estimate():
    assert score.noise_estimate(np.full((1, 32, 32), 0.5))[0] == 0
    noisy = np.random.default_rng(7).normal(0.5, 0.1, (64, 64, 64))
    assert np.median(score.noise_estimate(noisy)) == pytest.approx(0.10, abs=0.005)


def test_kernels():
    x = np.random.default_rng(1).random((2, 8, 8))
    assert np.allclose(score.resize(x, 8, 8), x)
    assert score.centre_square(np.random.default_rng(1).random((2, 8, 12)), 4).shape == (2, 4, 4)
    assert np.allclose(score.blur(np.full((1, 9, 9), 0.3), 1.0), 0.3)
    assert np.allclose(score.chain(score.KERNELS["flip"], score.KERNELS["flip"])(x), x)
    with pytest.raises(ValueError):
        score.preprocess(x, 4, "unknown")
    assert np.allclose(score.preprocess(np.full((1, 8, 8), 0.5), 4, "crop"), 0)


def test_folders_and_headers(spark, tmp_path):
    for folder, name, value in (("REAL", "a", 10), ("REAL", "b", 20), ("FAKE", "c", 30)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.png").write_bytes(images.write_png(bytes([value]) * 48, 4, 4))
    (tmp_path / "REAL" / "notes.txt").write_text("no image")
    (tmp_path / "FAKE" / "broken.jpg").write_bytes(b"not an image")
    got = sorted((r["path"].rsplit("/", 1)[1], r["label"]) for r in manifests.labelled_folder(spark, str(tmp_path)).collect())
    assert got == [("a.png", 0), ("b.png", 0), ("broken.jpg", 1), ("c.png", 1)]
    assert manifests.image_listing(spark, str(tmp_path)).count() == 4
    meta = {r["path"].rsplit("/", 1)[1]: (r["format"], r["width"], r["height"], r["mode"]) for r in images.file_metadata(spark, str(tmp_path)).collect()}
    assert meta["a.png"] == ("PNG", 4, 4, "RGB") and meta["broken.jpg"] == (None, None, None, None)
    pixels = {r["origin"].rsplit("/", 1)[1]: r["height"] for r in images.decoded(spark, str(tmp_path / "FAKE")).collect()}
    assert pixels == {"c.png": 4, "broken.jpg": -1}
    import hashlib

    data = (tmp_path / "REAL" / "a.png").read_bytes()
    pins = spark.createDataFrame([("a.png", len(data), hashlib.sha256(data).hexdigest()), ("b.png", len(data), "0"), ("z.png", 1, "0")], "name string, bytes long, sha256 string")
    state = {r["name"]: r["state"] for r in images.content_report(spark, str(tmp_path / "REAL"), pins).collect()}
    assert state == {"a.png": "ok", "b.png": "digest", "z.png": "missing", "notes.txt": "unexpected"}


def test_manifest_files(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"path":"a.png","label":0}\n{"path":"a.png","label":1}\n{"path":"b.png","label":2}\n{broken\n')
    rows = manifests.manifest(spark, str(path)).cache()
    got = {(r["path"], r["rule"]) for r in manifests.manifest_violations(rows).collect()}
    assert ("a.png", "duplicate_path") in got and ("b.png", "bad_label") in got and (None, "bad_json") in got
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("x", 1), ("y", 0)], "path string, label int")
    sinks.write_manifest(good, out, 1, "gate")
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ['{"label":0,"path":"y"}', '{"label":1,"path":"x"}']
    with pytest.raises(Exception, match="exists"):
        sinks.write_manifest(good, out, 1, "gate")
    with pytest.raises(ValueError):
        sinks.write_manifest(good.union(good), str(tmp_path / "other"), 1, "gate")


def test_resume_by_condition(spark, tmp_path):
    own, path = sinks.signature(seed=1), str(tmp_path / "p")
    rows = lambda c: spark.createDataFrame([(c, 1, 0.5)], "condition string, label int, score double")
    sinks.write_condition(rows("clean"), path, own)
    sinks.write_condition(rows("noise"), path, own)
    sinks.write_condition(rows("noise"), path, own)
    done = spark.read.parquet(path)
    assert done.count() == 2
    left, foreign = sinks.remaining_conditions(spark, ["clean", "noise", "blur"], done, own)
    assert [r["condition"] for r in left.collect()] == ["blur"] and foreign.isEmpty()
    left, foreign = sinks.remaining_conditions(spark, ["clean"], done, sinks.signature(seed=2))
    assert left.count() == 1 and foreign.count() == 2


def test_report_documents(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"images": [{"id": 1, "license": 4}, {"id": 2, "license": 5}]}')
    assert manifests.json_array(spark, str(tmp_path / "doc.json"), "images", "struct<id:int,license:int>").count() == 2
    (tmp_path / "clean_predictions.jsonl").write_text('{"label": 1, "score": 0.5}\n')
    assert [r["condition"] for r in manifests.condition_files(spark, str(tmp_path / "*_predictions.jsonl"), "label int, score double").collect()] == ["clean"]
    assert manifests.mentions(spark, str(tmp_path), "LABEL").count() == 1
    (tmp_path / "index.csv").write_text("path,IsFake\na,1\nb,0\n")
    assert manifests.flagged_csv(spark, str(tmp_path / "index.csv"), "IsFake", "1").count() == 1
    bad = spark.createDataFrame([('{"clean":{"labels":[1.0],"scores":[],"paths":[]}}',)], "doc string")
    assert manifests.progress_rows(bad, "doc")[1].count() == 1


def test_content_addressing(spark):
    rows = spark.createDataFrame([("h", "a", 3), ("h", "b", 3), ("i", "c", 4)], "h string, path string, bytes int")
    got = {r["h"]: (r["first_path"], r["n_paths"]) for r in sinks.content_addressed(rows, "h", "path", "bytes").collect()}
    assert got == {"h": ("a", 2), "i": ("c", 1)}


def test_scores_without_rank_raise(spark):
    for bad in (float("nan"), float("inf"), None):
        rows = spark.createDataFrame([(0, 0.5, "a", "x"), (1, bad, "a", "x"), (1, 0.9, "a", "x")], "label int, score double, generator string, real_source string")
        for call in (lambda df: metrics.auc(df), lambda df: metrics.wins(df, []), lambda df: errors.threshold_sweep(df, F.col("generator"))):
            with pytest.raises(Exception, match="finite"):
                call(rows).collect()


@pytest.mark.parametrize("hot", [0, 95])
def test_wins_and_thresholds_with_one_hot_source(spark, hot):
    import random

    rng = random.Random(hot)
    rows = []
    for _ in range(600):
        label = int(rng.random() < 0.3)
        source = "s0" if rng.random() * 100 < hot else f"s{rng.randrange(4)}"
        rows.append((label, rng.choice([rng.random(), 0.97 + 0.03 * rng.random(), 0.5, 1.0]), f"g{rng.randrange(3)}" if label else None, None if label else source))
    df = spark.createDataFrame(rows, "label int, score double, generator string, real_source string").repartition(7)
    want = {}
    for g in {r[2] for r in rows if r[0]}:
        for s in {r[3] for r in rows if not r[0]}:
            fakes, reals = ([r[1] for r in rows if r[2] == g], [r[1] for r in rows if r[3] == s])
            want[g, s] = (sum(2 * (a > b) + (a == b) for a in fakes for b in reals), len(fakes) * len(reals))
    assert {(r["generator"], r["real_source"]): (int(r["wins2"]), int(r["pairs"])) for r in metrics.wins(df, [], ranges=16).collect()} == want
    group = F.coalesce("generator", "real_source")
    swept = {r["threshold"]: (r["min_recall"], r["balanced_accuracy"]) for r in errors.threshold_sweep(df, group, ranges=16).collect()}
    assert set(swept) == {0.0, 0.5, 1.0, *(r[1] for r in rows)}
    for t, (low, balanced) in swept.items():
        by = {}
        for label, score, g, s in rows:
            by.setdefault((label, g or s), []).append(score >= t if label else score < t)
        assert low == pytest.approx(min(sum(x) / len(x) for x in by.values()), abs=1e-12)
        share = [sum(map(sum, (x for (k, _), x in by.items() if k == v))) / sum(len(x) for (k, _), x in by.items() if k == v) for v in (0, 1)]
        assert balanced == pytest.approx(sum(share) / 2, abs=1e-12)
    best = lambda only: one(errors.select_threshold(errors.threshold_sweep(df, group, ranges=16, best_only=only)))
    assert best(True) == best(False)


@pytest.mark.parametrize(("radius", "bits"), [(0, 64), (4, 64), (4, 63), (9, 63), (20, 63)])
def test_hash_pairs_equal_brute_force(spark, radius, bits):
    import random

    rng = random.Random(radius)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    left = [rng.getrandbits(bits) for _ in range(60)]
    right = [x ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(7))) for x in left for _ in range(2)] + [rng.getrandbits(bits) for _ in range(40)]
    frame = lambda xs: spark.createDataFrame(list(enumerate(map(signed, xs))), "k long, h long")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(left) for j, b in enumerate(right) if (a ^ b).bit_count() <= radius)
    assert sorted(map(tuple, neighbours.hamming_pairs(frame(left), frame(right), "k", "h", radius, bits).collect())) == want
    nearest = {}
    for i, j, n in want:
        nearest[i] = min(nearest.get(i, (99, 0)), (n, j))
    assert {r["a"]: (r["distance"], r["b"]) for r in neighbours.nearest_hash(frame(left), frame(right), "k", "h", radius, bits).collect()} == nearest


def test_overlap_audit_counts_copies_and_labels(spark):
    rows = [(1, 0, 0b1111, 7), (2, 0, 0b1111, 7), (3, 1, 0b0111, 7), (4, 1, 1 << 40, 7), (5, 1, 0b1111, -1)]
    df = spark.createDataFrame(rows, "k long, label int, d long, v long")
    got = one(neighbours.overlap_audit(df.filter("k < 3"), df.filter("k >= 3"), "k", "label", "d", "v"))
    assert (got["n_pairs"], got["n_cross_label"], got["examples"]) == (2, 2, "1:3:1:0")


def test_distribution_of_groups_null_too(spark):
    rows = [("a", float(x)) for x in range(11)] + [(None, 3.0), (None, 4.0), ("b", None)]
    got = {r["k"]: r for r in stats.distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (got["a"]["q05"], got["a"]["median"], got["a"]["q95"]) == (0.5, 5.0, 9.5) and got[None]["median"] == 3.5 and got["b"]["median"] is None


def test_noise_of_odd_sizes_and_colours():
    rng = np.random.default_rng(0)
    grey = rng.normal(0, 0.1, (1, 33, 31))
    assert score.noise_estimate(grey)[0] == score.noise_estimate(grey[:, :32, :30])[0]
    assert score.noise_estimate(rng.normal(0, 0.1, (1, 64, 64, 3)))[0] == pytest.approx(0.1, abs=0.01)


@pytest.mark.parametrize(("master", "works"), [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)])
def test_only_a_single_process_may_do_without_a_shared_folder(master, works):
    chosen = []

    class Context:
        def isDefined(self):  # noqa: N802  names of the session's own
            return bool(chosen)

        def get(self):
            return chosen[-1]

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return self

        def setCheckpointDir(self, folder):  # noqa: N802
            chosen.append(folder)

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    Session.sparkContext._jsc, Session.sparkContext.master = Session.sparkContext, master
    if works:
        assert order.shared_folder(Session()) == chosen[0]
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            order.shared_folder(Session())


def test_matrix_resume(spark, tmp_path):
    from evalmill.plans import jobs
    from evalmill.sources import sinks

    calls, names, own = [], ["x", "y"], sinks.signature(seed=1)

    def scored(todo):
        calls.append(list(todo))
        rows = [(c, i % 2, "g" if i % 2 else None, None if i % 2 else "s", i / 10) for c in todo for i in range(6)]
        return spark.createDataFrame(rows, "condition string, label int, generator string, real_source string, score double")

    folder = str(tmp_path / "matrix")
    sinks.write_condition(scored(["x"]), folder, own)
    got = jobs.resumed_matrix(spark, names, scored, folder, own)
    assert calls == [["x"], ["y"]] and {r["condition"] for r in got.collect()} == {"x", "y"}
    jobs.resumed_matrix(spark, names, scored, folder, own)
    assert calls == [["x"], ["y"]]
    with pytest.raises(ValueError, match="another run"):
        jobs.resumed_matrix(spark, names, scored, folder, sinks.signature(seed=2))
