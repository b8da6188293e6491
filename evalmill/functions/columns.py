"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_key(label: Column, generator: Column, real_source: Column, default: str = "unknown") -> Column:
    """PRJ-01: the generator of label-1 rows, the source of label-0 rows; null counts as missing."""
    return F.when(label == 1, F.coalesce(generator, F.lit(default))).otherwise(F.coalesce(real_source, F.lit(default)))


def first_non_empty(*names: Column, default: str | None = None) -> Column:
    """PRJ-02: the first name that is neither null nor blank."""
    found = [F.nullif(F.trim(x), F.lit("")) for x in names]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else []))


def identities(*hashes: Column) -> Column:
    """PRJ-03: the distinct hashes that a row has."""
    return F.array_distinct(F.array_compact(F.array(*hashes)))


def slug(text: Column, length: int = 40) -> Column:
    """SNK-07: lower-case letters and digits joined by single dashes."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def hash_rank(seed: int, namespace: str, *identity: Column) -> Column:
    """SMP-*: a rank text that depends on seed, namespace and identity only, never on row order or partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), *[x.cast("string") for x in identity]), 256)


def hash_uniform(seed: int, namespace: str, *identity: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the rank text."""
    return F.conv(F.substring(hash_rank(seed, namespace, *identity), 1, 12), 16, 10).cast("double") / float(1 << 48)


def blend(a: Column, b: Column, weight: float) -> Column:
    """PRJ-06: weight * a + (1 - weight) * b."""
    return weight * a + (1 - weight) * b


def routed(noise: Column, general_a: Column, general_b: Column, specialist: Column, threshold: float = 0.055) -> Column:
    """PRJ-08: the specialist from the noise threshold on, otherwise three quarters of a and one of b."""
    return F.when(noise >= threshold, specialist).otherwise(blend(general_a, general_b, 0.75))


def signed_round(x: Column, digits: int) -> Column:
    """``F.round`` that leaves a negative number that becomes zero a negative zero, as IEEE rounding (and DuckDB) does."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)


def linear_head(x: Column, weights: list[float], bias: float) -> Column:
    """PRJ-09: the logistic function of w.x + b."""
    return 1 / (1 + F.exp(-(dot(x, weights) + bias)))


def positive_head(x: Column, weights: list[float], bias: float) -> Column:
    """PRJ-10: positive parts of features and weights only."""
    return dot(F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(0.0))), [max(0.0, w) for w in weights]) + bias


def has_forbidden_part(path: Column, parts: list[str]) -> Column:
    """FLT-01: whether a component of the path is forbidden."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def has_forbidden_term(text: Column, terms: list[str]) -> Column:
    """FLT-02: whether a term occurs in the text in any case."""
    return F.greatest(*[F.contains(F.lower(text), F.lit(t.lower())) for t in terms], F.lit(False))


def difference_hash(x: Column) -> Column:
    """KRN-01: bit i is set where element i is greater than element i + 1; the first comparison is the highest bit."""
    bits = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.when(F.element_at(x, i) > F.element_at(x, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def average_hash(x: Column) -> Column:
    """KRN-02: bits set where an element is at least the mean."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size(x)
    return F.aggregate(F.transform(x, lambda v: F.when(v.cast("double") >= mean, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    """KRN-03: differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def lower_median(x: Column) -> Column:
    """The middle element, the lower one of two (not their mean)."""
    return F.element_at(F.array_sort(x), ((F.size(x) + 1) / 2).cast("int"))


def pair_noise(x: Column) -> Column:
    """KRN-04 on a vector: lower median of the absolute detail coefficients over the normal quartile."""
    detail = F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), lambda i: F.abs(F.get(x, i * 2).cast("double") - F.get(x, i * 2 + 1).cast("double")) / 1.4142135623730951)
    return lower_median(detail) / 0.67448975


def brightness(x: Column, factor: float) -> Column:
    """KRN-06."""
    return F.transform(x, lambda v: v.cast("double") * factor)


def contrast(x: Column, factor: float) -> Column:
    """KRN-06: distances from the mean scaled."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size(x)
    return F.transform(x, lambda v: mean + (v.cast("double") - mean) * factor)


def saturation(x: Column, factor: float) -> Column:
    """KRN-06 on interleaved RGB: distances of a pixel's colours from its luma scaled."""
    pixel = lambda i: F.floor(i / 3).cast("int") * 3
    luma = lambda i: F.lit(0.299) * F.get(x, pixel(i)).cast("double") + F.lit(0.587) * F.get(x, pixel(i) + 1).cast("double") + F.lit(0.114) * F.get(x, pixel(i) + 2).cast("double")
    return F.transform(x, lambda v, i: luma(i) + (v.cast("double") - luma(i)) * factor)


def centre_crop(x: Column, fraction: float) -> Column:
    """KRN-07: the middle part, its length rounded half to even, one element at least."""
    keep = F.greatest(F.lit(1), F.bround(F.size(x) * F.lit(float(fraction)), 0).cast("int"))
    return F.slice(x, (F.floor((F.size(x) - keep) / 2) + 1).cast("int"), keep)


def pooled_resize(x: Column, factor: int) -> Column:
    """KRN-08's analogue on a vector: means of ``factor`` neighbours, each repeated."""
    mean = lambda i: F.aggregate(F.slice(x, (i * factor + 1).cast("int"), factor), F.lit(0.0), lambda a, b: a + b.cast("double")) / factor
    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(x) / factor).cast("int") - 1), lambda i: F.array_repeat(mean(i), factor)))


def flipped(x: Column) -> Column:
    """KRN-11: the mirrored view."""
    return F.reverse(x)


def hashed_patch(x: Column, size: int, seed: int, *identity: Column) -> Column:
    """KRN-14: a window of ``size`` elements whose place is hashed from the identity."""
    offset = F.floor(hash_uniform(seed, "patch", *identity) * (F.size(x) - size + 1)).cast("int")
    return F.slice(x, offset + 1, size)


def ratio_bucket(seed: int, *identity: Column) -> Column:
    """KRN-15: one of four crop ratios by hash."""
    return (F.floor(hash_uniform(seed, "ratio", *identity) * 4)).cast("int")


def ratio_crop(x: Column, bucket: Column, ratios: list[float]) -> Column:
    """KRN-15: the middle part that is one over the bucket's ratio long, one element at least."""
    keep = F.greatest(F.lit(1), F.floor(F.size(x) / F.get(F.array(*map(F.lit, ratios)), bucket)).cast("int"))
    return F.slice(x, (F.floor((F.size(x) - keep) / 2) + 1).cast("int"), keep)


def gaussian_noise(x: Column, sigma: float, seed: int, index: Column, sample: Column) -> Column:
    """KRN-09: Box-Muller on uniforms hashed from (seed, condition, sample, place), clamped to [0, 1]; no state, no order."""

    def noisy(v: Column, i: Column) -> Column:
        uniform = lambda part: hash_uniform(seed, "noise", index, sample, i, F.lit(part)) + 0.5 / float(1 << 48)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") + sigma * F.sqrt(-2 * F.log(uniform(0))) * F.cos(6.283185307179586 * uniform(1))))

    return F.transform(x, noisy)
