"""Row kernels and scorers: named functions on Arrow batches, several heads in one pass, and models trained on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.functions.columns import hash_rank
from evalmill.operators.batches import map_frames

Kernel = Callable[[np.ndarray], np.ndarray]


def noise_estimate(images: np.ndarray) -> np.ndarray:
    """KRN-04: lower median of the absolute diagonal Haar coefficients over the normal quartile, for (n, height, width) or (n, height, width, 3).

    An odd last row or column is left out; colours count as one more axis of coefficients.
    """
    images = images[:, : images.shape[1] // 2 * 2, : images.shape[2] // 2 * 2]
    a, b, c, d = images[:, ::2, ::2], images[:, ::2, 1::2], images[:, 1::2, ::2], images[:, 1::2, 1::2]
    detail = np.sort(np.abs(a - b - c + d).reshape(len(images), -1) / 2, axis=1)
    return detail[:, (detail.shape[1] - 1) // 2] / 0.67448975


def blur(images: np.ndarray, sigma: float) -> np.ndarray:
    """KRN-10: separable Gaussian with reflected edges."""
    radius = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (1, 2):
        padded = np.pad(images, [(radius, radius) if i == axis else (0, 0) for i in range(images.ndim)], mode="symmetric")
        images = sum(w * np.take(padded, range(k, k + images.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return images


def resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """KRN-08/12/13: bilinear sampling at pixel centres."""
    ys = np.clip((np.arange(height) + 0.5) * images.shape[1] / height - 0.5, 0, images.shape[1] - 1)
    xs = np.clip((np.arange(width) + 0.5) * images.shape[2] / width - 0.5, 0, images.shape[2] - 1)
    y, x = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y + 1, images.shape[1] - 1), np.minimum(x + 1, images.shape[2] - 1)
    fy, fx = (ys - y)[None, :, None], (xs - x)[None, None, :]
    top = images[:, y][:, :, x] * (1 - fx) + images[:, y][:, :, x1] * fx
    return top * (1 - fy) + (images[:, y1][:, :, x] * (1 - fx) + images[:, y1][:, :, x1] * fx) * fy


def centre_square(images: np.ndarray, size: int) -> np.ndarray:
    """KRN-13: the central square, resized."""
    side = min(images.shape[1:3])
    top, left = (images.shape[1] - side) // 2, (images.shape[2] - side) // 2
    return resize(images[:, top : top + side, left : left + side], size, size)


def preprocess(images: np.ndarray, size: int, mode: str, mean: float = 0.5, deviation: float = 0.5) -> np.ndarray:
    """KRN-12: stretch, or short side then centre crop; scaled to mean and deviation."""
    if mode == "stretch":
        out = resize(images, size, size)
    elif mode == "crop":
        out = centre_square(images, size)
    else:
        raise ValueError(f"unknown mode {mode}")
    return (out - mean) / deviation


def chain(*kernels: Kernel) -> Kernel:
    """KRN-17: one kernel after the other."""

    def run(images: np.ndarray) -> np.ndarray:
        for kernel in kernels:
            images = kernel(images)
        return images

    return run


#: UDF-01: names that queries can refer to.
KERNELS: dict[str, Kernel] = {"identity": lambda x: x, "flip": lambda x: x[:, :, ::-1], "blur_1": lambda x: blur(x, 1.0), "half": lambda x: resize(resize(x, x.shape[1] // 2, x.shape[2] // 2), *x.shape[1:3])}
KERNELS["evaluation_crop"] = lambda x: preprocess(x, 4, "crop")
KERNELS["canonical_4"] = lambda x: centre_square(x, 4)
KERNELS["noise"] = lambda x: noise_estimate(x)[:, None]
KERNELS["flip_blur"] = chain(KERNELS["flip"], KERNELS["blur_1"])


def apply_kernel(rows: DataFrame, key: str, pixels: str, shape: tuple[int, int], kernel: str) -> DataFrame:
    """UDF-01: a registered kernel on an array column, as images of one shape."""
    height, width = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = np.stack(batch["__p"].to_numpy()).astype(float).reshape(-1, height, width) if len(batch) else np.empty((0, height, width))
            yield pd.DataFrame({key: batch[key], pixels: list(KERNELS[kernel](images).reshape(len(images), -1))})

    kind = dict(rows.dtypes)[key]
    return map_frames(rows.select(key, F.col(pixels).alias("__p")), run, f"`{key}` {kind}, `{pixels}` array<double>")


def score_rows(rows: DataFrame, key: str, vector: str, scorers: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """ML-05/07: every scorer's value for each row in one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = np.stack(batch["__v"].to_numpy()).astype(float) if len(batch) else np.empty((0, 1))
            yield pd.DataFrame({key: batch[key], **{n: f(matrix) for n, f in scorers.items()}})

    kind = dict(rows.dtypes)[key]
    return map_frames(rows.select(key, F.col(vector).alias("__v")), run, f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in scorers))


def shortcut_probe(train: DataFrame, held: DataFrame, numbers: list[str], kinds: list[str], key: str) -> DataFrame:
    """ML-01: how well metadata alone tells the labels apart: median-imputed, scaled numbers and one-hot kinds, balanced classes."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weighted = train.join(F.broadcast(counts), "label").withColumn("weight", 1.0 / F.col("n"))
    ready = [f"{n}_filled" for n in numbers]
    stages = [
        Imputer(strategy="median", inputCols=numbers, outputCols=ready), VectorAssembler(inputCols=ready, outputCol="__n"), StandardScaler(inputCol="__n", outputCol="__scaled", withMean=True),
        StringIndexer(inputCols=kinds, outputCols=[f"{k}_i" for k in kinds], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{k}_i" for k in kinds], outputCols=[f"{k}_h" for k in kinds]),
        VectorAssembler(inputCols=["__scaled", *[f"{k}_h" for k in kinds]], outputCol="features"), LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-3),
    ]
    fitted = Pipeline(stages=stages).fit(weighted)
    return PipelineModel(fitted.stages[:-1]).transform(held).select(key, "label", fitted_odds(fitted.stages[-1]).alias("score"))


def fitted_odds(model) -> Column:
    """A fitted logistic head on ``features`` as an expression of its weights.

    The model's own transform sends its training summary, and with that the session, to the tasks; that fails once the session has observed a metric.
    """
    return C.linear_head(vector_to_array("features"), model.coefficients.toArray().tolist(), model.intercept)


def linear_head(train: DataFrame, vector: str, weight: str | None = None, non_negative: bool = False):
    """ML-03/04: a logistic head on an embedding column, with sampling weights, its coefficients not below zero if asked for."""
    rows = train.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(maxIter=100, regParam=1e-3, standardization=False, **({"weightCol": weight} if weight else {}))
    if non_negative:
        from pyspark.ml.linalg import DenseMatrix

        size = rows.select(F.size(vector)).first()[0]
        model = model.setLowerBoundsOnCoefficients(DenseMatrix(1, size, [0.0] * size))
    return model.fit(rows)


def head_scores(model, rows: DataFrame, vector: str, key: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select(key, fitted_odds(model).alias("score"))


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` that have a vector, with it scaled to length 1 as the feature column; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = F.transform(vector, lambda x: x.cast("double") / F.greatest(F.lit(1e-300), norm))
    return rows.filter(F.col(vector).isNotNull()).withColumn("features", array_to_vector(scaled))


def cluster_fit(ready: DataFrame, key: str, vector: str, clusters: int, seed: int, block: int = 4096):
    """The k-means model of ``unit_vectors``. Rows are dealt by hash into blocks of about ``block`` rows, whose number and order
    depend on the rows only, so the fit doesn't depend on how the input is cut."""
    dealt = ready.repartition(max(1, -(-ready.count() // block)), key, vector).sortWithinPartitions(hash_rank(seed, "centres", F.col(key)), key)
    return KMeans(k=clusters, seed=seed, maxIter=30).fit(dealt.select("features"))


def unit_clusters(rows: DataFrame, key: str, vector: str, clusters: int, seed: int, block: int = 4096) -> DataFrame:
    """ML-06: k-means of unit vectors, fitted on all of them."""
    ready = unit_vectors(rows, vector)
    return cluster_fit(ready, key, vector, clusters, seed, block).transform(ready).select(key, F.col("prediction").alias("cluster"))


def cluster_properties(rows: DataFrame, key: str, vector: str, clusters: int, seed: int) -> DataFrame:
    """ML-06: (n_rows, n_clusters, nearest): whether every row is in the cluster whose centre is the nearest."""
    ready = unit_vectors(rows, vector)
    model = cluster_fit(ready, key, vector, clusters, seed)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]  # ``clusters`` vectors
    far = lambda c: F.aggregate(F.zip_with(vector_to_array("features"), F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    found = model.transform(ready).select(F.col("prediction").alias("cluster"), F.array(*[far(c) for c in centres]).alias("far"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.bool_and(F.get("far", F.col("cluster")) <= F.array_min("far") + 1e-9).alias("nearest"))


def diverse_choice(rows: DataFrame, key: str, vector: str, score: str, shortlist: int, clusters: int, seed: int) -> DataFrame:
    """SMP-14, ML-06: the best row of each k-means cluster of the best ``shortlist`` rows, ties by key."""
    ready = unit_vectors(rows.orderBy(F.desc(score), key).limit(shortlist), vector).repartition(1)
    grouped = KMeans(k=clusters, seed=seed, maxIter=30).fit(ready).transform(ready)
    best = Window.partitionBy("prediction").orderBy(F.desc(score), key)
    return grouped.withColumn("n", F.row_number().over(best)).filter("n = 1").select(key, score, F.col("prediction").alias("cluster"))


