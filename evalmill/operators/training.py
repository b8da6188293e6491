"""ML-03/04: a logistic head trained by epochs, every step one pass of gradient sums over Arrow batches.

Rows are dealt once, by a hash of their key, to steps (mini-batches) and, inside a step, to a fixed number of groups, and kept at
the checkpoint. In a step each task sends one sum for each of its groups, and the driver adds groups up in their order and moves the weights, which
are as many numbers as a vector has. So the sums don't depend on how rows are partitioned, and a lost executor costs its groups of one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.columns import hash_uniform
from evalmill.operators.batches import map_frames
from evalmill.operators.order import cut_lineage

GROUPS = 64


class Head(NamedTuple):
    """Weights, bias, and the weighted mean loss of each epoch, measured before each of its steps."""

    weights: np.ndarray
    bias: float
    losses: list[float]

    def odds(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights + self.bias


def gradient_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Of weighted rows: gradient by weights, by bias, loss, weight."""
    odds = x @ weights + bias
    error = w * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y)
    return np.concatenate([error @ x, [error.sum(), (w * (np.logaddexp(0, odds) - y * odds)).sum(), w.sum()]])


def dealt_rows(rows: DataFrame, key: str, vector: str, label: str, weight: str | None, steps: int, seed: int) -> DataFrame:
    """(step, group, key, label, weight, vector) of rows with a whole vector and a label; a group lies in one task, by key."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = F.col(key).cast("string").alias("key")
    ready = rows.select(own, F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    ready = ready.filter(F.col("vector").isNotNull() & finite & F.col("label").isin(0.0, 1.0) & F.col("weight").isNotNull())
    deal = lambda name, n: F.floor(hash_uniform(seed, name, F.col("key")) * n).cast("int")
    placed = ready.select(deal("step", steps).alias("step"), deal("group", GROUPS).alias("group"), "*")
    return cut_lineage(placed.repartition("group").sortWithinPartitions("group", "key", "vector"))


def train_head(rows: DataFrame, key: str, vector: str, label: str, weight: str | None = None, epochs: int = 5, steps: int = 1, rate: float = 0.5, decay: float = 0.0, non_negative: bool = False, adaptive: bool = False, seed: int = 1) -> Head:
    """``epochs`` times ``steps`` steps against the weighted mean log loss, from zero weights; ``weight`` is SMP-15's, say.

    ``adaptive``: Adam's moments with decoupled decay instead of plain steps. ``non_negative``: weights below zero become zero after each step.
    """
    dealt = dealt_rows(rows, key, vector, label, weight, steps, seed)
    first = dealt.select(F.size("vector").alias("n")).agg(F.max("n").alias("n"), F.min("n").alias("least")).first()
    if first["n"] is None:
        raise ValueError("no rows to train on")
    if first["n"] != first["least"]:
        raise ValueError(f"vectors of {first['least']} to {first['n']} entries")
    size = first["n"]
    theta, losses, moments, at = np.zeros(size + 1), [], np.zeros((2, size + 1)), 0

    def sums(step: int) -> np.ndarray:
        now = theta.copy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for group, part in batch.groupby("group"):
                    new = gradient_sums(np.stack(part["vector"].to_numpy()), part["label"].to_numpy(), part["weight"].to_numpy(), now[:-1], now[-1])
                    found[int(group)] = found[int(group)] + new if int(group) in found else new
            yield pd.DataFrame({"group": list(found), "sums": list(found.values())})

        parts = map_frames(dealt.filter(F.col("step") == step).select("group", "label", "weight", "vector"), run, "group int, sums array<double>")
        return np.sum([np.array(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["group"])] or [np.zeros(size + 3)], axis=0)  # GROUPS rows at most

    for _ in range(epochs):
        loss = mass = 0.0
        for step in range(steps):
            found = sums(step)
            loss, mass = loss + found[-2], mass + found[-1]
            if found[-1] <= 0:
                continue
            slope, at = found[:-2] / found[-1], at + 1
            if adaptive:
                moments[0] = 0.9 * moments[0] + 0.1 * slope
                moments[1] = 0.999 * moments[1] + 0.001 * slope**2
                slope = (moments[0] / (1 - 0.9**at)) / (np.sqrt(moments[1] / (1 - 0.999**at)) + 1e-8)
            theta = theta - rate * slope - rate * decay * np.append(theta[:-1], 0.0)
            if non_negative:
                theta[:-1] = np.maximum(0.0, theta[:-1])
        losses.append(float(loss / mass) if mass > 0 else 0.0)
    return Head(theta[:-1], float(theta[-1]), losses)


def epoch_rows(rows: DataFrame, head: Head) -> DataFrame:
    """(epoch, loss), epochs from 1."""
    return rows.sparkSession.createDataFrame([(i, loss) for i, loss in enumerate(head.losses, 1)], "epoch int, loss double")
