"""Risk curves over six horizons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_even

# Fixed values.
HORIZONS = (1, 2, 3, 4, 5, 6)
SCORE_COLUMNS = [f"year_{h}" for h in HORIZONS]
DROP_TOLERANCE = 1e-6


def curve_of(columns: list[str] = SCORE_COLUMNS) -> Column:
    return F.array(*[F.col(c) for c in columns])


def curve_violation(curve: Column) -> Column:
    """Null for a valid curve, else the first rule it breaks."""
    n = len(HORIZONS)
    inside = F.forall(curve, lambda s: s.isNotNull() & s.between(0.0, 1.0) & ~F.isnan(s))
    steps = F.zip_with(F.slice(curve, 1, n - 1), F.slice(curve, 2, n - 1), lambda a, b: b < a - DROP_TOLERANCE)
    return (
        F.when(curve.isNull() | (F.size(curve) != n), "length")
        .when(~inside, "range")
        .when(F.exists(steps, lambda d: d), "decrease")
    )


def require_valid(curve: Column) -> Column:
    """The curve itself, or a failed query naming the broken rule."""
    bad = curve_violation(curve)
    return F.when(bad.isNull(), curve).otherwise(
        F.raise_error(F.concat(F.lit("invalid risk curve: "), bad)).cast("array<double>"))


def monotone(curve: Column) -> Column:
    """Clip to [0, 1], then take the running maximum over the horizons."""
    seen = F.aggregate(
        curve,
        F.array().cast("array<double>"),
        lambda acc, v: F.array_append(acc, F.greatest(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)),
                                                      F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))),
    )
    return F.when(F.size(curve) > 0, seen).otherwise(curve)


def risk_struct(curve: Column, calibrated: Column) -> Column:
    """year_h fields, the curve (six digits) and the calibrated flag."""
    rounded = F.transform(curve, lambda v: half_even(v, 6))
    fields = [F.get(rounded, F.lit(i)).alias(f"year_{h}") for i, h in enumerate(HORIZONS)]
    return F.struct(*fields, rounded.alias("curve"), calibrated.alias("calibrated"))
