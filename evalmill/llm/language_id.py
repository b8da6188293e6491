"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its 1- to 4-grams of code points after lower-casing, everything but letters taken as one blank. Each is
hashed into one of ``BUCKETS`` embedding rows; a text is the mean of its rows, and a linear softmax over the languages follows.
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on the driver, over a bounded sample
(``PER_LANGUAGE`` documents of each language in hash order of doc_id, of the ``LANGUAGES`` most frequent languages) of labelled documents; Spark makes the features, so no text reaches the
driver. A fifth of the sample is set aside to calibrate: the softmax temperature with the least log loss, and the lowest
score from which on at least ``PRECISION`` of the answers are right; answers below it are marked ``rejected``. Since
the model is linear in the mean, embeddings times weights is one table of BUCKETS x languages, and that is what tasks get.

Cases: null texts and texts without letters are "und" with score 0 and rejected; documents with a null lang aren't learned from; a
single learned lang is always answered; with none at all every answer is "und".
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (1, 2, 3, 4)

#: Documents in the training sample: so many of each language, of so many languages; steps of training, whatever the sample's size.
PER_LANGUAGE, LANGUAGES, STEPS = 400, 64, 12_000

PRECISION = 0.99

#: What isn't a letter; word characters besides letters and decimal digits (², ½, Ⅷ and their like) are few and looked for only where there are some.
OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters_only(text: str) -> str:
    """``text`` with every stretch of other characters as one blank."""
    plain = OTHER.sub(" ", text)
    if plain.replace(" ", "x").isalpha():
        return plain
    return OTHER.sub(" ", "".join(c if c.isalpha() else " " for c in plain))


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all n-grams."""
    codes = np.frombuffer(f" {letters_only(text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(codes) < n:
            break
        mixed = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        found.append(mixed % np.uint32(BUCKETS))
    return np.concatenate(found).astype(np.int64)


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], languages: int, total: int = STEPS, rate: float = 2.0, seed: int = 7):
    """(embeddings, weights, bias) after ``total`` steps over (language number, buckets, shares of the text's subwords)."""
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, languages)), np.zeros(languages)
    order = np.concatenate([rng.permutation(len(samples)) for _ in range(-(-total // len(samples)))])[:total] if samples else []
    for step, k in enumerate(order):
        own, buckets, shares = samples[k]
        lr = rate * (1 - step / total)
        mean = shares @ embeddings[buckets]
        odds = mean @ weights + bias
        error = np.exp(odds - odds.max())
        error /= error.sum()
        error[own] -= 1
        back = weights @ error
        weights -= lr * np.outer(mean, error)
        bias -= 0.1 * lr * error
        embeddings[buckets] -= lr * shares[:, None] * back
    return embeddings, weights, bias


def calibrate(odds: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """(temperature, threshold) on documents that weren't trained on."""
    if not len(own):
        return 1.0, 0.0

    def probabilities(temperature):
        e = np.exp((odds - odds.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    # Smoothed targets: a sample without errors is no proof of certainty.
    target = np.full(odds.shape, 1 / ((len(own) + 2) * max(1, odds.shape[1] - 1)))
    target[np.arange(len(own)), own] = 1 - 1 / (len(own) + 2)
    loss = lambda t: -(target * np.log(np.maximum(1e-12, probabilities(t)))).sum(axis=1).mean()
    temperature = min((float(t) for t in np.geomspace(0.02, 8, 40)), key=loss)
    p = probabilities(temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == own
    order = np.argsort(-best, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(own) + 1) >= PRECISION
    return temperature, float(best[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0


def learn(labelled: DataFrame, sample: int = PER_LANGUAGE, languages_most: int = LANGUAGES):
    """(languages, table, bias, temperature, threshold) from (doc_id, text, lang) rows."""

    def shares(batches):
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                if has_letter(text):
                    buckets, counts = np.unique(subwords(text), return_counts=True)
                    rows.append((doc_id, lang, buckets, counts / counts.sum()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "buckets", "shares"])

    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    common = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages_most)
    # The rank is limited to the sample's size, which Spark applies in each partition before the shuffle too.
    order = Window.partitionBy("lang").orderBy("order", "doc_id")
    ranked = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("order")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample)
    chosen = ranked.join(F.broadcast(common.select("lang")), "lang", "left_semi")
    some = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # at most sample x languages_most ids
    # An id that many rows have counts once, so the sample is bounded whatever the ids are.
    some = some.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "d.text", "d.lang")
    rows = some.mapInPandas(shares, "doc_id long, lang string, buckets array<int>, shares array<float>").toLocalIterator()
    kept = sorted(((r["lang"], r["doc_id"], np.array(r["buckets"]), np.array(r["shares"], dtype=float)) for r in rows), key=lambda r: r[:2])
    languages = sorted({r[0] for r in kept})
    data = [(languages.index(lang), buckets, part) for lang, _, buckets, part in kept]
    held = data[::5] if len(data) >= 25 else []
    embeddings, weights, bias = train([d for i, d in enumerate(data) if not held or i % 5], len(languages))
    merged = embeddings @ weights
    odds = np.array([part @ merged[buckets] + bias for _, buckets, part in held]).reshape(len(held), len(languages))
    temperature, threshold = calibrate(odds, np.array([d[0] for d in held], dtype=int))
    return languages, merged.astype(np.float32), bias, temperature, threshold


def predict(docs: DataFrame, model, *keep: str) -> DataFrame:
    """(doc_id, keep..., lang_pred, score, rejected) from the whole text of each row; nothing else is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = {"lang_pred", "score", "rejected"}
    if clash := made.intersection(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename those that are to be kept")
    fields = docs.select("doc_id", *keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        languages, merged, bias, temperature, threshold = shared.value
        for batch in batches:
            answers = []
            for text in batch["__text"]:
                if not languages or text is None or not has_letter(text):
                    answers.append(("und", 0.0, True))
                    continue
                counts = np.bincount(subwords(text), minlength=BUCKETS)
                odds = ((counts @ merged) / counts.sum() + bias) / temperature
                e = np.exp(odds - odds.max())
                k = int(e.argmax())
                score = float(e[k] / e.sum())
                answers.append((languages[k], score, score < threshold))
            out = batch.drop(columns="__text")
            out["lang_pred"], out["score"], out["rejected"] = [a[0] for a in answers], [a[1] for a in answers], [a[2] for a in answers]
            yield out

    return map_frames(docs.select("doc_id", *keep, F.col("text").alias("__text")), run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = learn(docs.filter("NOT held_out"))
    return predict(docs.drop("lang"), model, "held_out")
