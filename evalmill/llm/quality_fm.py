"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (A-Z and the like lower-cased, hashed into ``BUCKETS`` places, log counts scaled to length 1),
one bin for each structure statistic (shares of capitals, symbols, digits, exclamation marks, table bars, repeated lines and
windows of three words, doubled and distinct words, word, line and text lengths) and one for the metadata that the table gives (``n_chars``).
The odds are b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j with vectors of ``RANK`` numbers; the pairs are
scored in linear time, as half of sum over f of (sum v_if x_i)^2 - sum (v_if x_i)^2.

It is trained by stochastic gradient descent (AdaGrad, logistic loss) in numpy on the driver, over a bounded sample: at most ``PER_LABEL``
labelled documents of each label, in hash order of doc_id. Machines trained without one of ``FOLDS`` parts of the sample score that
part; these odds give the two numbers that turn odds into probabilities (Platt's), each label weighted by its share of all labelled rows, so scores mean what they say
though the sample is balanced. Texts are turned to features where they lie; labels, lang, source and doc_id are no features.

Cases: a null text is empty; empty texts have statistics and a score too; a document with several labels is good if one of them
says so; null labels are left out; with labels of one kind, or none, every score is the labels' smoothed share. Ids that several
rows have are learned from once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

BUCKETS, RANK = 1 << 14, 8

#: Documents of each label in the training sample; steps of each training, whatever the sample's size; parts of the sample, each scored by a machine trained without it.
PER_LABEL, STEPS, FOLDS = 1500, 10_000, 3

#: Statistic -> lower edges of its bins after the first.
BINS = {
    "capitals": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "symbols": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "exclamations": (0.001, 0.02, 0.1, 0.3, 0.6),
    "bars": (0.001, 0.02, 0.1, 0.3),
    "repeated_lines": (0.001, 0.05, 0.1, 0.3, 0.5),
    "repeated_windows": (0.001, 0.02, 0.05, 0.1, 0.3, 0.5),
    "doubled_words": (0.001, 0.05, 0.1, 0.2, 0.4),
    "distinct_words": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "line_length": (10.0, 30.0, 60.0, 100.0, 200.0, 500.0, 2000.0),
    "words": (1.0, 10.0, 30.0, 50.0, 100.0, 200.0, 500.0, 1500.0, 5000.0),
    "n_chars": (0.0, 1.0, 50.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 20000.0),
}

#: Places of a statistic's bins behind the words' buckets.
PLACES = 1 + max(map(len, BINS.values()))
SIZE = BUCKETS + PLACES * len(BINS)

SPACES = np.array([9, 10, 11, 12, 13, 32])
SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]^~=+_\\/@", dtype=np.uint8)

TIMES, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """A number for each word, the sum of its code points mixed with their places in it."""
    inside = np.append(np.append(False, ~np.isin(codes, SPACES)), False)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    begins = np.zeros(len(codes), dtype=np.int64)
    begins[starts] = starts
    place = np.arange(len(codes)) - np.maximum.accumulate(begins)
    mixed = (codes.astype(np.uint64) + TIMES) * (place.astype(np.uint64) * ODD + TIMES)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD
    total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    hashes = total[ends] - total[starts]
    return hashes ^ (hashes >> np.uint64(32))


def statistics(text: str, codes: np.ndarray, words: np.ndarray, n_chars: float | None) -> list[float]:
    """The values of BINS, in their order."""
    n, low = max(1, len(codes)), codes[codes < 128].astype(np.uint8)
    kinds = np.bincount(low, minlength=128)
    share = lambda marks: float(kinds[np.asarray(marks)].sum()) / n
    lines = [line for line in text.split("\n") if line.strip()]
    distinct = len(np.unique(words)) / len(words) if len(words) else 1.0
    repeated, doubled = 0.0, float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    if len(words) > 3:
        windows = (words[:-2] * TIMES + words[1:-1]) * TIMES + words[2:]
        repeated = 1 - len(np.unique(windows)) / len(windows)
    # Capitals: code points that change when lower-cased.
    lower = text.lower()
    capitals = float((code_points(lower) != codes).sum()) / n if len(lower) == len(codes) else sum(map(str.isupper, text)) / n
    marks = kinds[[33, 63]].sum() / max(1, len(words))
    bars = float(kinds[124]) / max(1, len(words))
    dup = 1 - len(set(lines)) / len(lines) if lines else 0.0
    letters = (n - kinds[SPACES].sum()) / max(1, len(words))
    return [capitals, share(SYMBOLS), share(range(48, 58)), float(marks), bars, dup, repeated, doubled, distinct, float(letters), len(codes) / max(1, len(lines)), float(len(words)), -1.0 if n_chars is None else float(n_chars)]


EDGES = [np.array(edges) for edges in BINS.values()]


def features(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of one text."""
    words = word_hashes(code_points(text.lower()))
    buckets, counts = np.unique((words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values = values / max(1e-12, float(np.sqrt(values @ values)))
    own = [BUCKETS + PLACES * i + int(np.searchsorted(edges, value, side="right")) for i, (edges, value) in enumerate(zip(EDGES, statistics(text, code_points(text), words, n_chars)))]
    return np.append(buckets, own), np.append(values, np.full(len(own), 0.5))


class Machine(NamedTuple):
    """Bias, weights (SIZE), vectors (SIZE x RANK); probability = 1 / (1 + exp(-(slope odds + shift)))."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, places: np.ndarray, values: np.ndarray) -> float:
        scaled = self.vectors[places] * values[:, None]
        pairs = 0.5 * ((scaled.sum(axis=0) ** 2) - (scaled**2).sum(axis=0)).sum()
        return float(self.bias + self.weights[places] @ values + pairs)

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.odds(places, values) + self.shift, -500, 500))))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], total: int = STEPS, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Stochastic gradient descent over (label, places, values); both labels are drawn equally often."""
    rng = np.random.default_rng(seed)
    bias, weights, vectors = 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    seen_b, seen_w, seen_v = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    sides = [[s for s in samples if s[0] == label] for label in (0, 1)]
    if not all(sides):
        return Machine(0.0, weights, vectors * 0)
    draws = [rng.integers(0, len(side), total) for side in sides]
    for step in range(total):
        label, places, values = sides[step % 2][draws[step % 2][step]]
        own = vectors[places]
        scaled = own * values[:, None]
        sums = scaled.sum(axis=0)
        odds = bias + weights[places] @ values + 0.5 * (sums**2 - (scaled**2).sum(axis=0)).sum()
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label
        down_w = error * values + decay * weights[places]
        down_v = error * values[:, None] * (sums - scaled) + decay * own
        seen_b += error**2
        seen_w[places] += down_w**2
        seen_v[places] += down_v**2
        bias -= rate * error / seen_b**0.5
        weights[places] -= rate * down_w / np.sqrt(seen_w[places])
        vectors[places] -= rate * down_v / np.sqrt(seen_v[places])
    return Machine(bias, weights, vectors)


def calibrate(odds: np.ndarray, labels: np.ndarray, shares: tuple[float, float], rounds: int = 100) -> tuple[float, float]:
    """(slope, shift) of the probabilities with the least log loss, by Newton steps; targets are smoothed and labels weighted to ``shares``."""
    counts = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if not counts.all():
        return 1.0, 0.0
    target = np.where(labels == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    weight = np.array(shares)[labels] / counts[labels] * len(labels)
    x = np.stack([odds, np.ones_like(odds)], axis=1)
    theta = np.array([1.0, np.log(shares[1] / shares[0])])
    loss = lambda t: float((weight * (np.logaddexp(0, x @ t) - target * (x @ t))).sum()) + 1e-3 * float((t - [1.0, 0.0]) @ (t - [1.0, 0.0]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        slope = x.T @ (weight * (p - target)) + 2e-3 * (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, float(np.log(shares[1] / shares[0])))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> Machine:
    """A machine from ``docs`` (doc_id, text, n_chars if there is one) and ``labels`` (doc_id, quality)."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("n_chars"))
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    chosen = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_label).drop("place")  # bounded by 2 x per_label
    texts = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "label", "d.text", "d.n_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t, None if pd.isna(n) else n) for t, n in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "places": [p.astype(np.int32) for p, _ in made], "values": [v.astype(np.float32) for _, v in made]})

    rows = map_frames(texts, run, "doc_id long, label int, places array<int>, values array<float>").toLocalIterator()
    data = sorted(((r["doc_id"], r["label"], np.array(r["places"]), np.array(r["values"], dtype=float)) for r in rows), key=lambda r: r[0])
    total = sum(counts.values())
    smoothed = [(counts.get(k, 0) + 1) / (total + 2) for k in (0, 1)]
    if len(counts) < 2:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, RANK)), 1.0, float(np.log(smoothed[1] / smoothed[0])))
    number, parts = {0: 0, 1: 0}, []
    for _, label, places, values in data:
        parts.append((number[label] % FOLDS, (label, places, values)))
        number[label] += 1
    odds, seen = [], []
    for fold in range(FOLDS):
        without, held = train([d for k, d in parts if k != fold], steps), [d for k, d in parts if k == fold]
        odds += [without.odds(p, v) for _, p, v in held]
        seen += [label for label, _, _ in held]
    machine = train([d for _, d in parts], steps)
    slope, shift = calibrate(np.array(odds), np.array(seen, dtype=int), tuple(smoothed))
    return machine._replace(weights=machine.weights.astype(np.float32), vectors=machine.vectors.astype(np.float32), slope=slope, shift=shift)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every whole text; rows stay where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            found = [own.score(*features(t, None if pd.isna(n) else n)) for t, n in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": found})

    n_chars = (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("n_chars")
    return map_frames(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), n_chars), run, "doc_id long, score double")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    machine = learn(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
