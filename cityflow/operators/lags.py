"""Demand history per zone. Every window is partitioned by zone and bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cityflow.functions import calendar as cal

LAGS = (24, 168)


def _zone_hours() -> W:
    return W.partitionBy("zone_id").orderBy("hour_bucket")


def row_lags(mart: DataFrame) -> DataFrame:
    """Value 24 and 168 rows earlier in the zone; hours without trips have no row."""
    for n in LAGS:
        mart = mart.withColumn(f"demand_lag_{n}h", F.lag("trip_count", n).over(_zone_hours()))
    return mart


def overall_mean(mart: DataFrame):
    """Mean demand of all rows as a scalar subquery."""
    return mart.agg(F.avg("trip_count")).scalar()


def row_lags_filled(mart: DataFrame) -> DataFrame:
    """Row lags, with the overall mean where a zone has no such row yet."""
    fallback = overall_mean(mart)
    out = row_lags(mart)
    for n in LAGS:
        lag = F.col(f"demand_lag_{n}h").cast("double")
        out = out.withColumn(f"demand_lag_{n}h", F.coalesce(lag, fallback))
    return out


def calendar_lags(mart: DataFrame) -> DataFrame:
    """Value exactly 24 and 168 hours earlier by the clock, null where that hour had no trips.

    A one-value range frame finds the hour, so no self join is needed.
    """
    clock = W.partitionBy("zone_id").orderBy(cal.hour_index(F.col("hour_bucket")))
    for n in LAGS:
        mart = mart.withColumn(f"demand_lag_{n}h", F.max("trip_count").over(clock.rangeBetween(-n, -n)))
    return mart


def trailing_mean(rows: int, past_only: bool = False):
    """Mean of the last `rows` rows of the zone, with or without the current one."""
    frame = (-rows, -1) if past_only else (1 - rows, 0)
    return F.avg("trip_count").over(_zone_hours().rowsBetween(*frame))


def rolling_week(mart: DataFrame, past_only: bool = False) -> DataFrame:
    return mart.withColumn("demand_rolling_7d_avg", trailing_mean(168, past_only))


def demand_history(mart: DataFrame, past_only: bool = False) -> DataFrame:
    """Row lags and the trailing means that the feature matrix needs; one shuffle by zone."""
    return (
        row_lags(mart)
        .withColumn("demand_recent_avg", trailing_mean(24, past_only))
        .withColumn("demand_rolling_7d_avg", trailing_mean(168, past_only))
    )
