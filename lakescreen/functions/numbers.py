"""Numbers: clamping, banding, robust scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("double"), F.lit(low))))


def band(score: Column) -> Column:
    """LOW to 24, MEDIUM to 49, HIGH to 74, CRITICAL above."""
    return F.when(score <= 24, "LOW").when(score <= 49, "MEDIUM").when(score <= 74, "HIGH").when(score.isNotNull(), "CRITICAL")


def verdict_confidence(score: Column, degraded: Column) -> Column:
    """.55 and up to .45 less for degraded stages, .08 less within 2 of a band's edge, .10 at least."""
    near = F.lit(False)
    for edge in (24, 49, 74):
        near = near | (F.abs(score - edge) <= 2)
    return F.greatest(F.lit(0.10), 0.55 - F.least(F.lit(0.45), 0.12 * degraded) - F.when(near, 0.08).otherwise(0.0))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor of two whole numbers, by Euclid's steps in a fold."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y")),
        lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), F.try_mod(acc["x"], acc["y"]).alias("y"))),
    )
    return pair["x"]


def ledger_key(hex_id: Column) -> Column:
    """The first eight hex digits as a number; without those, the first eight of the text's SHA-256."""
    fits = hex_id.rlike("^[0-9a-fA-F]{8}")
    return F.conv(F.when(fits, F.left(hex_id, F.lit(8))).otherwise(F.left(F.sha2(hex_id, 256), F.lit(8))), 16, 10).cast("long")
