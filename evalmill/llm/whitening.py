"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers, x = floor(1024 c) + 100000, and all sums over rows are exact whole numbers, so the fit doesn't
depend on how rows are partitioned. A first pass gives the number of rows n and the sums S; a second one the scatter of
y = x - floor(S / n), from which n^2 V = n sum(y y') - R R' follows without rounding (R = S - n floor(S / n)). Each task sends
one number for each pair of dimensions, Spark adds them up, and the driver holds dimensions x dimensions numbers, whatever the
rows are. There V is factored with pivoting, V = G G' with G a row permutation of a lower triangle, and rotations from
the right make G's columns orthogonal: their squared norms are the eigenvalues, the normalised columns the components.
A third pass projects the rows; a fourth sum over the projections measures how far their covariance is from the identity.

Cases: a row goes if its vector is null or holds a null, NaN or infinite entry; entries of 2**40 or more in size count as
infinite. The vectors' length is the most frequent one (ties: the longer); rows of another length go, and so do empty vectors. Null ids
and repeated ids or rows are rows like any other. Components with no variance can't be scaled and aren't returned, so a single row, or
equal ones, give no rows. A deviation beyond 64 bits is null; ``distance2``, which is deviation / n^2, is always given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8

#: Entries from here on count as infinite, so that sums of squares fit in decimals of 38 digits.
LIMIT = 2.0**40

#: Bits of the digits into which numbers are cut where they are multiplied; rows whose products a double still adds up exactly.
DIGIT, EXACT_ROWS = 20, 1 << 13


class Whitening(NamedTuple):
    """n rows, centre = floor(S / n), rest = S - n centre, components as columns, their eigenvalues, the trace of V."""

    n: int
    centre: np.ndarray
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that stay, and the length of their vectors (0: there are none)."""
    read = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    good = read.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    most = good.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 0
    return good.filter(F.size("v") == length), length


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack(vectors.to_numpy())).astype(np.int64) + SHIFT


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Doubles d0, d1, ... with y = d0 + 2**DIGIT d1 + ..., as many as y needs; the last one has y's sign."""
    found, most = [], int(np.abs(y).max(initial=0))
    while most >= 1 << DIGIT:
        found.append((y & ((1 << DIGIT) - 1)).astype(float))
        y, most = y >> DIGIT, most >> DIGIT
    return [*found, y.astype(float)]


def products(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers of any size: products of digits are sums that doubles hold exactly."""
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for at in range(0, len(y), EXACT_ROWS):
        parts = digits(y[at : at + EXACT_ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total


def task_sums(rows: DataFrame, of_batch: Callable[[pd.DataFrame], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all batches of a small array: a task adds up its own and sends each entry once, Spark adds up tasks by entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = of_batch(batch)
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pd.DataFrame({"entry": np.arange(flat.size), "part": [Decimal(int(x)) for x in flat] if kind != "double" else flat})

    sums = map_frames(rows, run, f"entry int, part {kind}").groupBy("entry").agg(F.sum("part").alias("total"))
    return np.array([int(r["total"]) if kind != "double" else r["total"] for r in sums.orderBy("entry").collect()], dtype=object if kind != "double" else float)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with v = G G': columns by falling pivot, as many as have one above rounding; a lower triangle but for the order of its rows."""
    rest, g, pivots = v.diagonal().copy(), np.zeros_like(v), []
    least = len(v) * np.finfo(float).eps * rest.max(initial=0.0)
    while len(pivots) < len(v) and (top := rest.max()) > least:
        k, r = int(rest.argmax()), len(pivots)
        column = v[:, k] - g[:, :r] @ g[k, :r]
        column[pivots] = 0.0
        column[k] = top
        g[:, r] = column / np.sqrt(top)
        pivots.append(k)
        rest = rest - g[:, r] ** 2
        rest[pivots] = 0.0
    return g[:, : len(pivots)]


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of g g', falling, their unit vectors as columns): pairs of columns are turned until all are orthogonal.

    A round turns disjoint pairs at once, by the schedule of a round-robin tournament; a sweep has met every pair.
    """
    rows = g.T.copy()  # a column of g lies together
    r = len(rows)
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            a, b = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (a < r) & (b < r)
            p, q = a[real], b[real]
            x, y = rows[p], rows[q]
            alpha, beta, gamma = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            cosine = np.abs(gamma) / np.maximum(np.sqrt(alpha * beta), np.finfo(float).tiny)
            worst = max(worst, cosine.max(initial=0.0))
            turn = gamma != 0
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1.0), 0.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            rows[p], rows[q] = (c[:, None] * (x - t[:, None] * y), c[:, None] * (t[:, None] * x + y))
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= g.shape[0] * np.finfo(float).eps:
            break
    norms = (rows * rows).sum(axis=1)
    order = np.argsort(-norms, kind="stable")
    vectors = (rows[order] / np.sqrt(norms[order])[:, None]).T
    largest = np.abs(vectors).argmax(axis=0)
    return norms[order], vectors * np.sign(vectors[largest, np.arange(r)])


def fit(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (id, v) rows of one length; None without rows."""
    upper = np.triu_indices(length)
    rows = vectors.select("v")
    if not length:
        return None
    counted = task_sums(rows, lambda b: np.append(exact_sum(whole_numbers(b["v"])), len(b)), "decimal(38,0)")
    n, sums = counted[-1], counted[:-1]
    centre, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    scatter = np.empty((length, length), dtype=object)
    scatter[upper] = task_sums(rows, lambda b: products(whole_numbers(b["v"]) - centre)[upper], "decimal(38,0)")
    scatter.T[upper] = scatter[upper]
    covariance = np.array([[(n * scatter[i, j] - rest[i] * rest[j]) / n**2 for j in range(length)] for i in range(length)], dtype=float)
    values, units = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, centre, rest, units[:, :components], values[:components], float(covariance.trace()))


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums by column in whole numbers of any size."""
    return ((x >> DIGIT).sum(axis=0).astype(object) << DIGIT) + (x & ((1 << DIGIT) - 1)).sum(axis=0).astype(object)


def deviations(y: np.ndarray, model: Whitening) -> tuple[list[int], np.ndarray]:
    """Of each row y = x - centre: (sum of (n y - rest)^2, exact; the same over n^2)."""
    n, rest = model.n, model.rest
    far = 2 * model.n * int(np.abs(y).max(initial=0))
    if far * far * y.shape[1] < 1 << 62:
        exact = ((n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    else:
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
    return exact, np.array([e / n**2 for e in exact])


def projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows times components, scaled to variance 1."""
    return (y - np.array([r / model.n for r in model.rest])) @ (model.components / np.sqrt(model.eigenvalues))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the projections' covariance minus the identity, centred at their mean."""
    k = len(model.eigenvalues)

    def moments(batch: pd.DataFrame) -> np.ndarray:
        w = projected(whole_numbers(batch["v"]) - model.centre, model)
        return np.vstack([w.sum(axis=0), w.T @ w])

    found = task_sums(vectors.select("v"), moments, "double").reshape(k + 1, k) / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, distance2) for each row that stays and component."""
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, distance2 double"
    vectors, length = usable_vectors(rows, key, vector)
    model = fit(vectors, length, components)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    k, explained = len(model.eigenvalues), model.eigenvalues / model.trace

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            y = whole_numbers(batch["v"]) - model.centre
            exact, distance2 = deviations(y, model)
            yield pd.DataFrame(
                {
                    key: batch["id"].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1), len(y)), "n": model.n,
                    "deviation": pd.Series([e if e < 1 << 63 else None for e in exact], dtype="Int64").repeat(k).reset_index(drop=True), "whitened": projected(y, model).ravel(),
                    "explained": np.tile(explained, len(y)), "identity_error": error, "distance2": distance2.repeat(k),
                }
            )

    return map_frames(vectors, run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
