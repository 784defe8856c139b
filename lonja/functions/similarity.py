"""Similarity and numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def hashed(words: Column) -> Column:
    """Words as 64-bit hashes, in their order: sets of whole numbers meet several times faster than sets of texts."""
    return F.transform(words, lambda t: F.xxhash64(t))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard_of(both: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats that share `both` values."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def overlap_of(both: Column, a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.least(F.size(a), F.size(b)))


def quotient_similarity(a: Column, b: Column) -> Column:
    """exp(-|ln(1 + a) - ln(1 + b)|) as a quotient, which every engine rounds alike; less than 0 counts as 0."""
    a, b = 1 + F.greatest(a, F.lit(0.0)), 1 + F.greatest(b, F.lit(0.0))
    return F.least(a, b) / F.greatest(a, b)


def log_similarity(a: Column, b: Column, scale: float) -> Column:
    return F.exp(-scale * F.abs(a - b))


def relative_difference(a: Column, b: Column) -> Column:
    """Difference over the larger; 1 where either is missing."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b)).otherwise(1.0)


def relative_similarity(a: Column, b: Column, scale: float) -> Column:
    """exp(-scale * difference); 0.5 where either is missing."""
    return F.when((a > 0) & (b > 0), F.exp(-scale * F.abs(a - b) / F.greatest(a, b))).otherwise(0.5)


def first_positive(*values: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v) for v in values], F.lit(0.0))


def round_quantity(x: Column) -> Column:
    """0 if not positive; the whole number within a thousandth; else six places, by plain double arithmetic as other engines do it."""
    return F.when(x.isNull() | (x <= 0), 0.0).when(F.abs(x - F.rint(x)) <= 1e-3, F.rint(x)).otherwise(F.floor(x * 1e6 + 0.5) / 1e6)


def units_per_sale(sale: Column, case: Column, most: int = 1000) -> Column:
    return F.when((sale > 0) & (case > 0) & (F.pmod(case, sale) == 0), F.least(case / sale, F.lit(float(most)))).otherwise(1.0)


def log_safe(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def presentation_score(kind_a: Column, kind_b: Column, factor: Column, content: Column, total: Column, weight: Column) -> Column:
    """Weighted agreement of kind, factor, content, total and weight; an unknown kind counts 0.65."""
    kind = F.when((kind_a == "NONE") | (kind_b == "NONE"), 0.65).when(kind_a == kind_b, 1.0).otherwise(0.0)
    return 0.20 * kind + 0.22 * factor + 0.20 * content + 0.23 * total + 0.15 * weight


def presentation_tier(kind_a: Column, kind_b: Column, factor: Column, *others: Column) -> Column:
    """0 (same presentation) to 4, from relative differences of the factor and of content, total and weight."""
    ok, best = (kind_a == kind_b) | (kind_a == "NONE") | (kind_b == "NONE"), F.least(*others)
    return F.when(ok & (factor <= 0.02) & (best <= 0.08), 0).when(ok & (best <= 0.15), 1).when(ok & (factor <= 0.10), 2).when(ok, 3).otherwise(4)
