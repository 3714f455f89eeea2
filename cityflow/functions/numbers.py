"""Order-independent sums, guarded ratios and the rounding rules.

Sums of doubles depend on the order in which partitions arrive. Amounts are
therefore summed as whole units of 1/10000 in BIGINT: exact, associative,
and still primitive arithmetic inside generated code. Only results are rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal digits kept by the exact sums.
SCALE = {"fare_amount": 4, "total_amount": 4, "trip_distance": 4}


def units(name: str) -> Column:
    """Whole units; null for NaN, infinities and amounts beyond BIGINT, which ``unusable`` counts."""
    return F.rint(F.col(name) * float(10 ** SCALE[name])).try_cast("bigint")


def sums(*names: str) -> list[Column]:
    """Partial sums `<name>_units` and `<name>_n` that can be added up again later."""
    out = []
    for name in names:
        out.append(F.sum(units(name)).alias(f"{name}_units"))
        out.append(F.count(units(name)).alias(f"{name}_n"))
    return out


def unusable(name: str) -> Column:
    """Rows with an amount that neither sums nor counts take."""
    return F.count(F.when(F.col(name).isNotNull() & units(name).isNull(), 1))


def resums(*names: str) -> list[Column]:
    """Add up the partial sums of a finer grouping."""
    out = []
    for name in names:
        out.append(F.sum(f"{name}_units").alias(f"{name}_units"))
        out.append(F.sum(f"{name}_n").alias(f"{name}_n"))
    return out


def total_of(name: str, digits: int = 2) -> Column:
    return F.round(F.col(f"{name}_units").cast("double") / float(10 ** SCALE[name]), digits)


def mean_of(name: str, digits: int = 2) -> Column:
    whole = F.col(f"{name}_n").cast("double") * float(10 ** SCALE[name])
    return F.round(F.try_divide(F.col(f"{name}_units").cast("double"), whole), digits)


def ratio_pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, null when the whole is zero, half away from zero."""
    return F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def change_pct(new: Column, old: Column, digits: int = 1) -> Column:
    return ratio_pct(new - old, old, digits)


def safe_float(value: Column) -> Column:
    """Null, NaN and infinities become 0.0; everything else keeps four digits."""
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.0).otherwise(F.round(value, 4))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
