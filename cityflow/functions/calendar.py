"""Calendar expressions on wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _trunc(unit: str, ts: ColumnOrName) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hour_bucket(ts: ColumnOrName) -> Column:
    return _trunc("hour", ts)


def week_start(ts: ColumnOrName) -> Column:
    """Monday 00:00 of the week."""
    return _trunc("week", ts)


def month_start(ts: ColumnOrName) -> Column:
    """First day of the month as a date."""
    return F.trunc(F.to_date(ts), "MM")


def hour_of_day(ts: ColumnOrName) -> Column:
    return F.hour(ts)


def day_of_week(ts: ColumnOrName) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def day_name(ts: ColumnOrName) -> Column:
    return F.date_format(ts, "E")


def is_weekend(ts: ColumnOrName) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0)


def months_before(ts: Column, months: int) -> Column:
    """Same time of day n months earlier, clamped to the month's end."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def hour_index(ts: Column) -> Column:
    """Hours since the epoch: an integer axis for clock-exact window frames."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
