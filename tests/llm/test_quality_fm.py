import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import quality_fm as fm
from tests.llm import cases


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = fm.op12_quality_classifier(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows.count() == docs.count()
    assert rows.filter((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull() | (F.col("predicted") != (F.col("score") >= 0.3).cast("int"))).count() == 0
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0
    held = rows.filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 5 and np.mean([g > b for g in good for b in bad]) >= 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    places, values = rng.choice(fm.SIZE, 30, replace=False), rng.normal(0, 1, 30)
    machine = fm.Machine(0.3, rng.normal(0, 1, fm.SIZE), rng.normal(0, 1, (fm.SIZE, fm.RANK)))
    want = 0.3 + sum(machine.weights[p] * v for p, v in zip(places, values))
    want += sum(machine.vectors[places[i]] @ machine.vectors[places[j]] * values[i] * values[j] for i in range(30) for j in range(i))
    assert machine.odds(places, values) == pytest.approx(want)


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    samples = []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        samples.append((int(a ^ b), np.array([10 + a, 20 + b]), np.ones(2)))
    machine = fm.train(samples, 8000)
    assert all((machine.odds(p, v) > 0) == (label == 1) for label, p, v in samples)


def test_words_and_statistics():
    text = "Ab cd\tab\nCD  efg\x0bab 😀é\x1cx"
    hashes = fm.word_hashes(fm.code_points(text.lower()))
    assert len(hashes) == 7 and hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3] and len(set(hashes)) == 4
    assert len(fm.word_hashes(fm.code_points(""))) == len(fm.word_hashes(fm.code_points(" \n"))) == 0
    names = list(fm.BINS)
    of = lambda t, n=None: dict(zip(names, fm.statistics(t, fm.code_points(t), fm.word_hashes(fm.code_points(t.lower())), n)))
    assert of("AB!! 12 | #a")["capitals"] == 2 / 12 and of("AB!! 12 | #a")["symbols"] == 2 / 12 and of("AB!! 12 | #a")["exclamations"] == 2 / 4
    assert of("x\nx\ny\n\n")["repeated_lines"] == pytest.approx(1 / 3) and of("a b c a b c")["repeated_windows"] == 0.25
    assert of("", 7.0)["n_chars"] == 7 and of("")["n_chars"] == -1 and of("İİ")["capitals"] == 1.0


def test_calibration_gives_back_shares():
    rng = np.random.default_rng(3)
    labels = np.repeat([0, 1], 500)
    odds = rng.normal(0, 1, 1000) + 3 * labels - 1.5
    slope, shift = fm.calibrate(odds, labels, (0.1, 0.9))
    p = 1 / (1 + np.exp(-(slope * odds + shift)))
    assert 0.1 * p[labels == 0].mean() + 0.9 * p[labels == 1].mean() == pytest.approx(0.9, abs=0.02)
    assert fm.calibrate(odds[:500], labels[:500], (0.5, 0.5)) == (1.0, 0.0)


def test_cases(spark):
    docs = cases.docs(spark)
    rows = [(5, 1), (6, 0), (6, 1), (13, 0), (7, None), (None, 0), (10, 0), (cases.BIG, 1), (cases.BIG + 2, 1), (999, 0), (1, 0)]
    labels = spark.createDataFrame([(i, q, "x") for i, q in rows], "doc_id long, quality int, text string")
    machine = fm.learn(docs, labels, 50, 500)
    got = fm.score(docs, machine).collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == sorted(i or 0 for i, _, _ in cases.texts())
    assert all(0 <= r["score"] <= 1 for r in got)
    by_partition = fm.score(docs.repartition(5), fm.learn(docs.repartition(3), labels.repartition(2), 50, 500)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in by_partition)
    assert fm.score(cases.no_docs(spark), machine).count() == 0
    assert fm.score(docs.drop("n_chars"), machine).count() == len(got)
    none = fm.learn(docs, labels.limit(0))
    assert {r["score"] for r in fm.score(docs, none).collect()} == {0.5}
    good = fm.learn(docs, labels.filter("quality = 1"))
    assert len({r["score"] for r in fm.score(docs, good).collect()}) == 1
