"""AGG-25: bootstrap replicates as vectors of counters: every row is read once and holds a counter for each replicate.

In the stratified bootstrap a replicate draws from each label as many rows as it has. A draw's place among the rows of its label is hashed;
tasks count the draws of a replicate by blocks of places, and a block's rows take over their counters: a byte for each row and replicate is shuffled.
In the Poisson bootstrap a row counts as often as a Poisson(1) variable of (seed, key, replicate) says, so its counters come from its own key. Rows are dealt by score ranges; a task walks through its range once and adds counters up, all
replicates at a time. What leaves a task are three segments (its lowest score, what lies between, its highest score), each
with one vector of positives, negatives and doubled wins. So ranges times replicates are shuffled, never rows times replicates. A
frequent score may lie in many ranges: the segments of one score are added up before they are put in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.batches import map_frames
from evalmill.operators.metrics import WIDE, checked, ratio
from evalmill.operators.order import cut_lineage, with_group_index

#: 32-bit numbers from which on a Poisson(1) counter is at least 1, 2, ...
EDGES = [round(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(11)]

#: Rows whose counters a task holds at a time.
ROWS = 256

SEGMENTS = "score double, between int, p array<long>, n array<long>, w array<long>"


def counters(keys: list[str], seed: int, replicates: int) -> np.ndarray:
    """One row for each key, one column for each replicate: eight 32-bit numbers of every SHA-256 of (seed, key, eighth of the replicates)."""
    eighths = -(-replicates // 8)
    digests = b"".join(hashlib.sha256(f"{seed}:{key}:{c}".encode()).digest() for key in keys for c in range(eighths))
    drawn = np.frombuffer(digests, dtype=">u4").reshape(len(keys), -1)[:, :replicates]
    return np.searchsorted(np.array(EDGES, dtype=np.uint64), drawn.astype(np.uint64), side="right").astype(np.int64)


class _Range:
    """Running sums over rows by rising score: the first cell, what follows it, and the cell that is still open."""

    def __init__(self, replicates: int):
        zero = lambda: np.zeros(replicates, dtype=np.int64)
        self.first = self.open_ = None
        self.p, self.n, self.w = zero(), zero(), zero()

    def close(self) -> None:
        score, p, n = self.open_
        if self.first is None:
            self.first = self.open_
        else:
            self.w += p * (2 * self.n + n)
            self.p += p
            self.n += n
        self.open_ = None

    def add(self, scores: np.ndarray, labels: np.ndarray, drawn: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        p, n = (np.add.reduceat(drawn * (labels == y)[:, None], starts, axis=0) for y in (1, 0))
        for i, at in enumerate(starts):
            if self.open_ is not None and self.open_[0] == scores[at]:
                self.open_ = (scores[at], self.open_[1] + p[i], self.open_[2] + n[i])
            else:
                if self.open_ is not None:
                    self.close()
                self.open_ = (scores[at], p[i], n[i])

    def segments(self) -> list[tuple]:
        cells = [c for c in (self.first, self.open_) if c is not None]
        found = [(float(s), 0, p, n, np.zeros_like(p)) for s, p, n in cells]
        return found + ([(float(self.first[0]), 1, self.p, self.n, self.w)] if self.first is not None else [])


#: Draws that a task counts at a time, and places of a block of counters.
DRAWS, PLACES = 1_000_000, 1024


def drawn_rows(rows: DataFrame, key: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(key, label, columns, times): a byte for each replicate says how often it drew the row, from as many draws as the row's label has rows."""
    ranked = cut_lineage(with_group_index(rows.select(key, "label", *columns), "at", ["label"], key))
    sizes = ranked.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.sparkSession.range(0, replicates, 1, 4 * parts).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(sizes))
    runs = runs.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"), F.lit(DRAWS).cast("long"))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run in batch.itertuples():
                head, draws = f"{seed}:{run.replicate}:{run.label}:", range(run.first, min(run.first + DRAWS, run.size + 1))
                digests = b"".join([hashlib.sha256(f"{head}{i}".encode()).digest()[:6] + b"\0\0" for i in draws])
                at = np.sort((np.frombuffer(digests, dtype=">u8") >> 16).astype(np.int64) % run.size)
                blocks, starts = np.unique(at // PLACES, return_index=True)
                counts = [np.bincount(own - block * PLACES, minlength=PLACES) for block, own in zip(blocks, np.split(at, starts[1:]))]
                yield pd.DataFrame({"label": run.label, "block": blocks, "replicate": run.replicate, "counts": [_bytes(c) for c in counts]})

    kind, label = dict(rows.dtypes)[key], dict(rows.dtypes)["label"]
    counted = map_frames(runs.select("label", "size", "replicate", "first"), draw, f"label {label}, block long, replicate long, counts binary")

    def take(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros((PLACES, replicates), dtype=np.int64)
        for replicate, counts in zip(counted["replicate"], counted["counts"]):
            times[:, replicate] += np.frombuffer(counts, dtype=np.uint8)
        mine = times[(own["at"] % PLACES).to_numpy()]
        return own[[key, "label", *columns]].assign(times=[_bytes(t) for t in mine])

    placed = ranked.withColumn("block", F.expr(f"at div {PLACES}"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.select(*columns).dtypes)
    return placed.groupBy("label", "block").cogroup(counted.groupBy("label", "block")).applyInPandas(take, f"`{key}` {kind}, label {label}, {kinds}, times binary")


def _bytes(counts: np.ndarray) -> bytes:
    if counts.max(initial=0) > 255:
        raise ValueError("a row was drawn more than 255 times in a replicate")
    return counts.astype(np.uint8).tobytes()


def range_segments(rows: DataFrame, key: str, score: str, replicates: int, seed: int, times: str | None = None) -> DataFrame:
    """The segments of every range of one score; counters are the bytes of ``times``, if that is given, else Poisson ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Range(replicates)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                own.add(part["s"].to_numpy(), part["label"].to_numpy(), np.frombuffer(b"".join(part["times"]), dtype=np.uint8).reshape(len(part), -1).astype(np.int64) if times else counters(part["key"].tolist(), seed, replicates))
        yield pd.DataFrame(own.segments(), columns=["score", "between", "p", "n", "w"])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = checked(rows.select(F.col(key).cast("string").alias("key"), "label", F.col(score).cast("double").alias("s"), *([F.col(times).alias("times")] if times else [])), "s")
    return map_frames(ready.repartitionByRange(parts, "s", F.xxhash64("key")).sortWithinPartitions("s"), run, SEGMENTS)


def replicate_aucs(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, replicate, auc) of segments: cells of one score are added up, then all are put in order."""
    flat = segments.select(*keys, "score", "between", F.posexplode(F.arrays_zip("p", "n", "w")).alias("replicate", "x"))
    cells = flat.groupBy(*keys, "replicate", "score", "between").agg(*[F.sum(f"x.{c}").alias(c) for c in "pnw"])
    before = Window.partitionBy(*keys, "replicate").orderBy("score", "between").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wins = F.when(F.col("between") == 1, F.col("w").cast(WIDE)).otherwise(F.col("p").cast(WIDE) * F.col("n")) + 2 * F.col("p").cast(WIDE) * F.col("before")
    total = placed.groupBy(*keys, "replicate").agg(F.sum(wins).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*keys, "replicate", ratio(F.col("w"), F.col("p").cast(WIDE) * F.col("n")).alias("auc"))


def bootstrap_auc(rows: DataFrame, key: str, score_a: str, score_b: str, replicates: int, seed: int) -> DataFrame:
    """AGG-25, Poisson: paired bootstrap of two AUCs and their difference: 2.5 %, median and 97.5 % points; both scores of a row have its counters."""
    return _points([range_segments(rows, key, s, replicates, seed) for s in (score_a, score_b)])


def stratified_bootstrap_auc(rows: DataFrame, key: str, score_a: str, score_b: str, replicates: int, seed: int) -> DataFrame:
    """AGG-25: the same points of the paired, stratified bootstrap; every replicate draws as many rows of each label as there are."""
    drawn = cut_lineage(drawn_rows(checked(checked(rows, score_a), score_b), key, [score_a, score_b], replicates, seed))
    return _points([range_segments(drawn, key, s, replicates, seed, "times") for s in (score_a, score_b)])


def _points(segments: list[DataFrame]) -> DataFrame:
    named = [s.withColumn("candidate", F.lit(c)) for c, s in zip("ab", segments)]
    pick = lambda c: F.max(F.when(F.col("candidate") == c, F.col("auc")))
    wide = replicate_aucs(cut_lineage(named[0].unionByName(named[1])), ["candidate"]).groupBy("replicate").agg(pick("a").alias("auc_a"), pick("b").alias("auc_b")).withColumn("delta", F.col("auc_b") - F.col("auc_a"))
    tall = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("auc_a", "auc_b", "delta")])).alias("x")).select("x.metric", "x.v")
    q = lambda p: F.round(F.percentile("v", p), 9)
    return tall.groupBy("metric").agg(q(0.025).alias("q025"), q(0.5).alias("median"), q(0.975).alias("q975"))
