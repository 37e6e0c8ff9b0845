"""Distances and similarities of array columns, and scalar scores, as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; clipped to [-1, 1]."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def chi_square(a: Column, b: Column, half: bool = False, eps: float = 1e-8) -> Column:
    s = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2 / (x.cast("double") + y.cast("double") + eps)))
    return s / 2 if half else s


def similarity_of(distance: Column, sigma: float | None = None) -> Column:
    """1 / (1 + d), or the Gaussian of the distance."""
    return 1 / (1 + distance) if sigma is None else F.exp(-(distance**2) / (2 * sigma**2))


def gap_score(gap: Column, target: float = 5.0, tolerance: float = 1.0, penalty: float = 1.0, most: float = 20.0) -> Column:
    """struct(score, penalty): (1, 0) within the tolerance, (0, a large penalty) beyond `most`, linear between."""
    off = F.abs(gap - target)
    score = F.when(off <= tolerance, 1.0).when(gap > most, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (off - tolerance) / (most - target)) if most - target >= 1e-12 else 0.0)
    fine = F.when(off <= tolerance, 0.0).when(gap > most, penalty * (gap - most + off)).otherwise(penalty * (off - tolerance))
    return F.struct(score.alias("score"), fine.alias("penalty"))


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "A").when(score >= 0.70, "B").when(score >= 0.55, "C").when(score >= 0.40, "D").otherwise("F")


# Weights of the parts of a confidence.
CONFIDENCE_WEIGHTS = (1.5, 1.0, 0.8, 1.2, 1.0)


def confidence(parts: list[Column], weights: tuple[float, ...] = CONFIDENCE_WEIGHTS) -> Column:
    """Weighted mean of the parts' scores."""
    return sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0)) / sum(weights)


def css_similarity(a: Column, b: Column) -> Column:
    """Cosine of two descriptors, cut to the shorter one, in [0, 1]; a descriptor without any entry above 0 has 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.greatest(F.lit(0.0), cosine(x, y))


def css_similarity_mirror(a: Column, b: Column) -> Column:
    """The better one of a descriptor and its mirror image, as mating edges run against each other."""
    return F.greatest(css_similarity(a, b), css_similarity(a, F.reverse(b)))


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)
