"""SQL twins of pixel kernels that are linear: an image is rows times weights times columns, with weights made by rule."""

from __future__ import annotations

import math

Matrix = list[list[float]]


def blur_weights(side: int, sigma: float) -> Matrix:
    """Gaussian weights of each output place, mirrored at the edges."""
    radius = max(1, int(3 * sigma + 0.5))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    rows = [[0.0] * side for _ in range(side)]
    for i in range(side):
        for k, w in enumerate(raw):
            p = i + k - radius
            rows[i][-1 - p if p < 0 else 2 * side - 1 - p if p >= side else p] += w / sum(raw)
    return rows


def resize_weights(to: int, length: int) -> Matrix:
    """Bilinear weights at pixel centres."""
    rows = [[0.0] * length for _ in range(to)]
    for i in range(to):
        at = min(max((i + 0.5) * length / to - 0.5, 0.0), length - 1.0)
        low = math.floor(at)
        rows[i][low] += 1 - (at - low)
        rows[i][min(low + 1, length - 1)] += at - low
    return rows


def bicubic_weights(to: int, length: int) -> Matrix:
    """Cubic convolution at pixel centres, by the distance of each place in (widened) pixels."""

    def weight(x: float) -> float:
        x = abs(x)
        return (x * 1.5 - 2.5) * x * x + 1 if x < 1 else ((2.5 - x * 0.5) * x - 4) * x + 2 if x < 2 else 0.0

    raw = [[weight((j + 0.5 - (i + 0.5) * length / to) / max(1.0, length / to)) for j in range(length)] for i in range(to)]
    return [[w / sum(line) for w in line] for line in raw]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * row[j] for x, row in zip(line, b)) for j in range(len(b[0]))] for line in a]


def window(start: int, keep: int, length: int) -> Matrix:
    """The places from ``start`` on."""
    return [[float(j == start + i) for j in range(length)] for i in range(keep)]


def mirrored(rows: Matrix) -> Matrix:
    return [line[::-1] for line in rows]


def linear_sql(down: Matrix, across: Matrix, scale: str = "{}", digits: int = 9) -> str:
    """The list expression of down x image x across, each value through ``scale`` and rounded; digits None leaves it as it is."""
    height, width = len(down[0]), len(across[0])
    listed = lambda rows: "[" + ", ".join(f"{x!r}::DOUBLE" for line in rows for x in line) + "]"
    out = len(across)
    cell = f"{listed(down)}[(i // {out}) * {height} + k // {width} + 1] * {listed(across)}[(i % {out}) * {width} + k % {width} + 1] * CAST(embedding[k + 1] AS DOUBLE)"
    value = scale.format(f"list_sum(list_transform(range(0, {height * width}), lambda k: {cell}))")
    return f"list_transform(range(0, {len(down) * out}), lambda i: {f'round({value}, {digits})' if digits is not None else value})"


def condition_sql(name: str, idx: int, sample: str, seed: int, side: int = 8) -> str:
    """The pixels of a grey square ``embedding`` with values in [0, 1] under a condition, as a list expression."""
    kind, _, strength = name.rpartition("_")
    inside = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
    each = lambda value: f"list_transform(embedding, lambda x, i: {value})"
    if kind == "blur_sigma":
        return linear_sql(blur_weights(side, float(strength)), blur_weights(side, float(strength)), digits=None)
    if kind == "resize":
        small = max(1, round(side * float(strength)))
        both = times(bicubic_weights(side, small), bicubic_weights(small, side))
        return linear_sql(both, both, inside, None)
    if kind == "center_crop":
        keep = max(1, round(side * float(strength) / 100))
        part = window((side - keep) // 2, keep, side)
        return linear_sql(part, part, digits=None)
    if kind == "brightness":
        return each(inside.format(f"x * {strength}::DOUBLE"))
    if kind == "contrast":
        mean = f"(list_sum(embedding) / {side * side})"
        return each(inside.format(f"{mean} + (x - {mean}) * {strength}::DOUBLE"))
    if kind == "noise_sigma":
        digest = f"sha256(concat('{seed}:noise:{idx}:', CAST({sample} AS VARCHAR), ':', CAST((i - 1) // 4 AS VARCHAR)))"
        u = lambda k: f"((CAST(('0x' || substr({digest}, CAST(16 * ((i - 1) % 4) + {8 * k + 1} AS BIGINT), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
        return each(inside.format(f"x + {strength}::DOUBLE * sqrt(-2 * ln({u(0)})) * cos(6.283185307179586::DOUBLE * {u(1)})"))
    return "embedding"  # clean, and the saturation of grey


def score_sql(pixels: str, side: int, weights: Matrix, slope: float) -> str:
    """The logistic of a weighted sum over the square ``pixels`` resized to the weights' side."""
    down = resize_weights(len(weights), side)
    flat = [sum(weights[a][b] * down[a][p // side] * down[b][p % side] for a in range(len(weights)) for b in range(len(weights))) for p in range(side * side)]
    listed = "[" + ", ".join(f"{v!r}::DOUBLE" for v in flat) + "]"
    return f"1 / (1 + exp(-{slope}::DOUBLE * list_sum(list_transform(range(0, {side * side}), lambda k: {listed}[k + 1] * {pixels}[k + 1]))))"
