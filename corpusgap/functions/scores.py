"""Column expressions that score: citations, recency, decay, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_weight(citations: Column, year: Column, as_of: int) -> Column:
    """Log citations over age to the power 0.7; a missing year counts as five years ago."""
    age = F.when(year.isNotNull() & (year != 0), F.greatest(F.lit(as_of) - year, F.lit(0))).otherwise(5)
    return F.log1p(F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0))) / F.pow(1 + age, F.lit(0.7))


def recency_weight(year: Column, as_of: int) -> Column:
    """1 up to two years, then 0.8, 0.6 and 0.4 by pairs of years; 0.5 without a year."""
    age = F.greatest(F.lit(as_of) - year, F.lit(0))
    return F.when(year.isNull() | (year == 0), 0.5).when(age <= 2, 1.0).when(age <= 4, 0.8).when(age <= 6, 0.6).otherwise(0.4)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def recency_score(year: Column, as_of: int, first: int = 2020) -> Column:
    """Rises from 0 in ``first`` to 1 in ``as_of``; bad years give 0."""
    y = year.try_cast("double") if hasattr(year, "try_cast") else year.cast("double")
    return F.coalesce(clamp((y - first) / max(1, as_of - first)), F.lit(0.0))


def citation_score(citations: Column) -> Column:
    c = citations.try_cast("double") if hasattr(citations, "try_cast") else citations.cast("double")
    return F.coalesce(clamp(F.log10(1 + F.greatest(c, F.lit(0.0))) / 4), F.lit(0.0))


def composite(similarity: Column, recency: Column, citations: Column, affinity: Column) -> Column:
    return 0.65 * similarity + 0.15 * recency + 0.10 * citations + 0.10 * affinity


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or (nearly) zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 1e-9, dot(a, b) / norms), F.lit(0.0))


def decay(days: Column, tau: float) -> Column:
    return F.exp(-F.greatest(days, F.lit(0.0)) / tau)


def logistic_confidence(x: Column) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-0.5 * (x - 2.5))), F.lit(0.1)), F.lit(0.99))


# Weights of interaction kinds.
KIND_WEIGHTS = {"open": 0.3, "like": 1.0, "save": 1.0, "dislike": -0.8, "hide": -0.5}


def kind_weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in KIND_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def vote_weight(vote: Column, pursue: Column) -> Column:
    return F.when(F.coalesce(pursue, F.lit(False)) | (vote == "up"), 1.0).when(vote == "down", -0.6).otherwise(0.0)
