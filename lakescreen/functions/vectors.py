"""Vector similarity and the three-way face verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The verdict's thresholds.
MATCH_FROM, NO_MATCH_TO = 0.363, 0.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def verdict(similarity: Column) -> Column:
    return F.when(similarity >= MATCH_FROM, "MATCH").when(similarity <= NO_MATCH_TO, "NO_MATCH").otherwise("INCONCLUSIVE")


def verdict_confidence(similarity: Column, issues: Column, major: Column) -> Column:
    """min(.95, .82 + 1.2 margin - penalty), penalty min(.35, .12 issues + .05 major); the margin is that to the verdict's threshold."""
    margin = F.when(similarity >= MATCH_FROM, similarity - MATCH_FROM).when(similarity <= NO_MATCH_TO, NO_MATCH_TO - similarity).otherwise(0.0)
    penalty = F.least(F.lit(0.35), 0.12 * issues + 0.05 * major)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.82 + 1.2 * margin - penalty))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
