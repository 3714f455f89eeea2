"""The hour x zone feature mart.

Trips are counted per (hour, zone) first; the dimensions join the counts, not
the trips. A hot hour or zone is folded map-side before the one shuffle of the
fact. No join carries a hint: Spark broadcasts a dimension when its measured
size allows it and otherwise shuffles the already small count frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.functions import calendar as cal
from cityflow.functions import weather as wx

WEATHER_COLUMNS = (
    "temperature_f",
    "feels_like_f",
    "precipitation_mm",
    "windspeed_mph",
    "humidity_pct",
    "weather_code",
    "is_raining",
    "is_snowing",
)
EVENT_COLUMNS = ("has_major_event", "event_attendance")
ECONOMIC_COLUMNS = ("unemployment_rate", "gas_price_avg", "consumer_sentiment")
TIME_COLUMNS = ("hour_of_day", "day_of_week", "month", "is_weekend")
MART_COLUMNS = (
    ("hour_bucket", "zone_id", "trip_count")
    + TIME_COLUMNS
    + WEATHER_COLUMNS
    + EVENT_COLUMNS
    + ECONOMIC_COLUMNS
)


def hourly_counts(trips: DataFrame) -> DataFrame:
    """Trips per hour and zone, from trips or from counts that are already folded."""
    if "trip_count" in trips.columns:
        return trips.groupBy("hour_bucket", "zone_id").agg(F.sum("trip_count").alias("trip_count"))
    return trips.groupBy(
        cal.hour_bucket(F.col("pickup_dt")).alias("hour_bucket"),
        F.col("pickup_zone").alias("zone_id"),
    ).agg(F.count("*").alias("trip_count"))


def with_calendar(counts: DataFrame) -> DataFrame:
    h = F.col("hour_bucket")
    return counts.select(
        "hour_bucket",
        "zone_id",
        "trip_count",
        cal.hour_of_day(h).alias("hour_of_day"),
        cal.day_of_week(h).alias("day_of_week"),
        F.month(h).alias("month"),
        cal.is_weekend(h).alias("is_weekend"),
    )


def events_per_day(events: DataFrame) -> DataFrame:
    """One row per date: any major event, attendance added up."""
    return events.groupBy("event_date").agg(
        F.max(F.col("is_major").cast("int")).alias("_major"),
        F.sum("est_attendance").alias("_attendance"),
        F.lit(1).cast("bigint").alias("_copies"),
    )


def events_as_listed(events: DataFrame) -> DataFrame:
    """Every distinct (date, major, attendance) stays a row; repeats are counted."""
    return events.groupBy(
        "event_date",
        F.col("is_major").cast("int").alias("_major"),
        F.col("est_attendance").cast("bigint").alias("_attendance"),
    ).agg(F.count("*").alias("_copies"))


def ml_features(
    trips: DataFrame,
    weather: DataFrame,
    events: DataFrame,
    economics: DataFrame,
    columns: tuple[str, ...] = MART_COLUMNS,
    event_rows: str = "per_day",
    unknown_weather: int | None = 0,
) -> DataFrame:
    """Build the mart; only dimensions that supply a requested column are joined.

    ``event_rows="per_day"`` keeps one row per (hour, zone). ``"as_listed"``
    repeats a row for every differing event of its day, as a plain left join of
    the trips with the event list would. ``unknown_weather`` is the value of the
    rain and snow flags in hours without an observation.
    """
    mart = with_calendar(hourly_counts(trips))
    wanted = set(columns)
    if wanted & set(WEATHER_COLUMNS):
        code = F.col("weather_code")
        obs = weather.select(
            F.col("obs_dt").alias("hour_bucket"),
            *WEATHER_COLUMNS[:6],
            wx.is_raining(code).cast("int").alias("_rain"),
            wx.is_snowing(code).cast("int").alias("_snow"),
        )
        mart = (
            mart.join(obs, "hour_bucket", "left")
            .withColumn("is_raining", F.coalesce("_rain", F.lit(unknown_weather)))
            .withColumn("is_snowing", F.coalesce("_snow", F.lit(unknown_weather)))
            .drop("_rain", "_snow")
        )
    if event_rows == "as_listed" or wanted & set(EVENT_COLUMNS):
        shape = events_as_listed if event_rows == "as_listed" else events_per_day
        mart = (
            mart.withColumn("event_date", F.to_date("hour_bucket"))
            .join(shape(events), "event_date", "left")
            .withColumn("trip_count", F.col("trip_count") * F.coalesce("_copies", F.lit(1)))
            .withColumn("has_major_event", F.coalesce("_major", F.lit(0)))
            .withColumn("event_attendance", F.coalesce("_attendance", F.lit(0)))
        )
        if event_rows == "as_listed":
            # A listed event with empty fields falls into the same group as "no event".
            keys = [c for c in mart.columns if c not in ("trip_count", "_copies", "_major", "_attendance")]
            mart = mart.groupBy(*keys).agg(F.sum("trip_count").alias("trip_count"))
    if wanted & set(ECONOMIC_COLUMNS):
        econ = economics.select("month_start", *ECONOMIC_COLUMNS)
        mart = mart.withColumn("month_start", cal.month_start(F.col("hour_bucket"))).join(
            econ, "month_start", "left"
        )
    return mart.select(*[c for c in MART_COLUMNS if c in wanted])
