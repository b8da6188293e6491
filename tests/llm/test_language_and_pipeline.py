from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evalmill.llm import language_id
from tests.llm import cases


def test_held_out_accuracy(spark, sf_dir):
    rows = language_id.op10_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = rows.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    assert rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0


def test_language_cases(spark):
    docs = cases.docs(spark)
    model = language_id.learn(docs)
    rows = language_id.predict(docs, model, "lang").collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] in {"en", "fr", "de", "es", "und"} for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}
    none = language_id.learn(cases.no_docs(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(cases.no_docs(spark), model).count() == 0


def test_only_letters_count(spark):
    docs = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 12 ___ !"), (3, "²a"), (None, "long enough"), (cases.BIG, "ja, gewiß")], "doc_id long, text string")
    model = language_id.learn(cases.docs(spark))
    rows = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert set(rows) == {1, 2, 3, None, cases.BIG}
    assert [i for i, r in rows.items() if r["lang_pred"] == "und"] == [1, 2] and rows[1]["score"] == 0
    assert language_id.subwords("² ab ½ c").tolist() == language_id.subwords("ab c").tolist()


def brute_answer(text, model):
    """The same prediction, gram by gram in plain numbers."""
    languages, merged, bias, temperature, _ = model
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} "
    total, n = np.zeros(len(languages)), 0
    for size in (1, 2, 3, 4):
        for i in range(len(padded) - size + 1):
            h = size
            for c in padded[i : i + size]:
                h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                h ^= h >> 15
            total += merged[h % language_id.BUCKETS]
            n += 1
    odds = (total / n + bias) / temperature
    e = np.exp(odds - odds.max())
    return languages[int(e.argmax())], float(e.max() / e.sum())


def test_predictions_against_plain_numbers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs, 60)
    rows = language_id.predict(docs.filter("length(text) BETWEEN 1 AND 1500"), model, "text").collect()
    seen = 0
    for r in rows:
        if any(c.isalpha() for c in r["text"]):
            want = brute_answer(r["text"], model)
            assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-4)
            seen += 1
    assert seen > 50


def test_rare_languages_are_learned_and_names_kept(spark):
    rows = [(i, f"plain words number {cases.words(5, i)}", "en") for i in range(600)] + [(1000 + i, "żółć gęślą jaźń", "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, 50)
    assert model[0] == ["en", "xx"]
    assert language_id.learn(docs, 50, 1)[0] == ["en"]
    with pytest.raises(ValueError, match="score"):
        language_id.predict(docs.withColumn("score", F.lit(1)), model, "score")


def test_calibration_rejects_what_is_uncertain():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2, 400)
    odds = np.where(np.arange(2)[None, :] == own[:, None], 3.0, 0.0)
    odds[:40] = rng.normal(0, 0.1, (40, 2))
    temperature, threshold = language_id.calibrate(odds, own)
    assert temperature > 0 and 0.5 < threshold <= 1
    assert language_id.calibrate(np.empty((0, 2)), np.empty(0, int)) == (1.0, 0.0)


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    docs = cases.docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = Counter(r["doc_id"] for r in docs.collect())
    assert kept == Counter({6: 1, 8: 1, 10: 1, None: 1, cases.BIG: 1})
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.no_docs(spark), sf_dir).count() == 0


def test_run_equals_its_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pieces) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in docs.collect())


@pytest.mark.parametrize("n", range(1, 14))
def test_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
