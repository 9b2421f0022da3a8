"""Column builders for money, scores, bands and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a pay period in a year.
PERIODS = {"hourly": 2080, "weekly": 52, "monthly": 12}


def yearly(amount: Column, period: Column) -> Column:
    out = amount
    for name, units in PERIODS.items():
        out = F.when(F.lower(period) == name, amount * units).otherwise(out)
    return out


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def band(c: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that the value reaches; bounds descend. Null has no band."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for low, label in bounds:
        out = out.when(c >= low, label)
    return out.otherwise(otherwise)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def interval_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Share of interval b that interval a covers."""
    return clamp(F.least(a_high, b_high) - F.greatest(a_low, b_low), 0, float("inf")) / F.nullif(b_high - b_low, F.lit(0))
