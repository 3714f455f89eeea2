"""Health of the mart and the drift report's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the drift report (fixed values).
DRIFT_COLUMNS = (
    "zone_id",
    "hour_of_day",
    "day_of_week",
    "month",
    "is_weekend",
    "temperature_f",
    "precipitation_mm",
    "windspeed_mph",
    "humidity_pct",
    "is_raining",
    "is_snowing",
    "has_major_event",
    "event_attendance",
)
TARGET = "trip_count"
NUMERIC = tuple(c for c in DRIFT_COLUMNS if c != "zone_id") + (TARGET,)


def period_slice(mart: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the half-open period [start, end), oldest first."""
    h = F.col("hour_bucket")
    return (
        mart.filter((h >= F.lit(start).cast("timestamp_ntz")) & (h < F.lit(end).cast("timestamp_ntz")))
        .select("hour_bucket", *DRIFT_COLUMNS, TARGET)
        .orderBy("hour_bucket", "zone_id")
    )


def mart_health(mart: DataFrame) -> DataFrame:
    """Size, coverage and missing inputs of the mart in one pass."""
    missing = lambda c: F.sum(F.col(c).isNull().cast("bigint"))
    share = lambda c: F.round(missing(c) * 100.0 / F.count("*"), 2)
    return mart.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("zone_id").alias("zones"),
        F.countDistinct(F.to_date("hour_bucket")).alias("days"),
        F.round(F.avg("trip_count"), 6).alias("avg_demand"),
        missing("temperature_f").alias("missing_weather"),
        missing("unemployment_rate").alias("missing_econ"),
        share("temperature_f").alias("missing_weather_pct"),
        share("unemployment_rate").alias("missing_econ_pct"),
    )
