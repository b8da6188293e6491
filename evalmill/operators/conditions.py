"""KRN-05, JOB-19: the evaluation conditions as named kernels on pictures; one pass reads a picture once and gives all conditions.

A picture is rows x columns x channels in [0, 1]. A condition's name says kernel and strength; its place in the catalogue seeds its
noise, which is hashed from (seed, place, sample, pixel), so it depends on no order. JPEG conditions need an encoder, which
isn't here: asking for one raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.operators.batches import map_frames
from evalmill.operators.score import blur, centre_square

#: What a condition does to pictures (n, height, width, channels) of samples: (pictures, samples, place in the catalogue, seed).
Condition = Callable[[np.ndarray, Sequence[str], int, int], np.ndarray]

LUMA = np.array([0.299, 0.587, 0.114])


def bicubic_weights(to: int, length: int) -> np.ndarray:
    """Cubic convolution (a = -0.5) at pixel centres, widened where it shrinks; one row of weights for each output place."""
    scale = length / to
    wide = max(scale, 1.0)
    x = np.abs((np.arange(length)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * scale) / wide)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def down_up(pictures: np.ndarray, scale: float) -> np.ndarray:
    """KRN-08: shrunk and brought back to size, both bicubic."""
    sides = [bicubic_weights(n, small) @ bicubic_weights(small, n) for n in pictures.shape[1:3] for small in [max(1, round(n * scale))]]
    return np.clip(np.einsum("yh,nhwc,xw->nyxc", sides[0], pictures, sides[1]), 0, 1)


def normals(samples: Sequence[str], place: int, size: int, seed: int) -> np.ndarray:
    """KRN-09: Box-Muller on hashed numbers, four pairs of every SHA-256 of (seed, place, sample, quarter of the pixels)."""
    quarters = -(-size // 4)
    digests = b"".join(hashlib.sha256(f"{seed}:noise:{place}:{s}:{q}".encode()).digest() for s in samples for q in range(quarters))
    u = ((np.frombuffer(digests, dtype=">u4").astype(float) + 0.5) / 2.0**32).reshape(len(samples), -1, 2)[:, :size]
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


def luma(pictures: np.ndarray) -> np.ndarray:
    """Grey levels with one channel, which a grey picture has already."""
    return pictures if pictures.shape[3] == 1 else (pictures @ LUMA)[..., None]


def towards(pictures: np.ndarray, other: np.ndarray, factor: float) -> np.ndarray:
    """KRN-06: distances from ``other`` scaled, in [0, 1]."""
    return np.clip(other + (pictures - other) * factor, 0, 1)


def central(pictures: np.ndarray, fraction: float) -> np.ndarray:
    """KRN-07: the middle part, sides rounded half to even."""
    (h, w), (kh, kw) = pictures.shape[1:3], (max(1, round(n * fraction)) for n in pictures.shape[1:3])
    top, left = (h - kh) // 2, (w - kw) // 2
    return pictures[:, top : top + kh, left : left + kw]


def kernel(name: str) -> Condition:
    """The kernel that a condition's name means."""
    kind, _, strength = name.rpartition("_")
    plain: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
        "blur_sigma": blur, "resize": down_up, "brightness": lambda x, f: towards(x, np.zeros_like(x), f), "contrast": lambda x, f: towards(x, luma(x).mean(axis=(1, 2, 3), keepdims=True), f),
        "saturation": lambda x, f: towards(x, luma(x), f), "center_crop": lambda x, f: central(x, f / 100),
    }
    if name == "clean":
        return lambda x, samples, place, seed: x
    if kind == "noise_sigma":
        return lambda x, samples, place, seed: np.clip(x + float(strength) * normals(samples, place, x[0].size, seed).reshape(x.shape), 0, 1)
    if kind not in plain:
        raise ValueError(f"no kernel for condition {name}")
    return lambda x, samples, place, seed: plain[kind](x, float(strength))


def each_condition(rows: DataFrame, key: str, pixels: str, shape: tuple[int, int, int], catalogue: Sequence[str], wanted: Sequence[str], seed: int, score: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, idx, condition, pixels), or a score in place of pixels, of every picture under every wanted condition; a picture is read once.

    A null picture, or one with another number of values, has no conditions.
    """
    kernels = [(catalogue.index(name), name, kernel(name)) for name in wanted]
    size, kind = int(np.prod(shape)), dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024].reset_index(drop=True)
                pictures, samples = np.stack(part["pixels"].to_numpy()).astype(float).reshape(-1, *shape), part["sample"].tolist()
                for place, name, act in kernels:
                    made = act(pictures, samples, place, seed)
                    yield pd.DataFrame({key: part[key], "idx": place, "condition": name, "made": list(made.reshape(len(made), -1)) if score is None else score(made)})

    whole = rows.filter(F.size(pixels) == size).select(key, F.col(key).cast("string").alias("sample"), F.col(pixels).cast("array<double>").alias("pixels"))
    name, type_ = ("score", "double") if score else ("pixels", "array<double>")
    return map_frames(whole, run, f"`{key}` {kind}, idx int, condition string, made {type_}").withColumnRenamed("made", name)


def linear_score(weights: np.ndarray, slope: float) -> Callable[[np.ndarray], np.ndarray]:
    """ML-05's head: the central square of grey levels, resized to the weights' side, through a logistic."""
    side = len(weights)

    def score(pictures: np.ndarray) -> np.ndarray:
        grey = centre_square(luma(pictures)[..., 0], side)
        return 1 / (1 + np.exp(-slope * (grey * weights).sum(axis=(1, 2))))

    return score
