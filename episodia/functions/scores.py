"""Score expressions over parsed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import strip


def partial_credit(gold: Column, given: Column) -> Column:
    """Credit that shrinks with the distance; a distance beyond 64 bits leaves nothing."""
    gap = F.abs(F.try_subtract(gold, given).cast("double"))
    return F.coalesce(F.pow(F.lit(fixed.PARTIAL_CREDIT), gap), F.lit(0.0))


def typed_score(gold: str = "g_", given: str = "p_") -> Column:
    """Score of two typed answers; unlike kinds score nothing."""
    def both(kind: str) -> Column:
        return (F.col(f"{gold}kind") == kind) & (F.col(f"{given}kind") == kind)

    same_text = F.lower(strip(F.col(f"{gold}s"))) == F.lower(strip(F.col(f"{given}s")))
    overlap = F.size(F.array_intersect(f"{gold}l", f"{given}l")).cast("double") / F.nullif(
        F.size(f"{gold}l"), F.lit(0)).cast("double")
    return (
        F.when(both("int"), F.when(same_text, F.lit(1.0)).otherwise(
            partial_credit(F.col(f"{gold}i"), F.col(f"{given}i"))))
        .when(both("string"), same_text.cast("double"))
        .when(both("list"), F.coalesce(overlap, F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def exact(score: Column) -> Column:
    """Decimal form of a score: its sums do not depend on the order of addition."""
    return score.cast("decimal(20,12)")
