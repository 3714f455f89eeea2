"""Prediction requests: validation and conversion to model rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflow.functions import calendar as cal
from cityflow.functions import weather as wx

# field -> (type, lowest, highest, default); no default means the field is required (fixed values).
RULES = {
    "zone_id": ("int", 1, 263, None),
    "temperature_f": ("double", -40.0, 130.0, None),
    "feels_like_f": ("double", -50.0, 140.0, None),
    "precipitation_mm": ("double", 0.0, 500.0, 0.0),
    "windspeed_mph": ("double", 0.0, 200.0, 0.0),
    "humidity_pct": ("double", 0.0, 100.0, 50.0),
    "weather_code": ("int", 0, 99, 0),
    "event_attendance": ("int", 0, None, 0),
}


def validate_requests(requests: DataFrame) -> DataFrame:
    """Typed requests with defaults, the hour snapped, and the list of failed fields in `errors`.

    A row is accepted when `errors` is empty.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)

    fields = {
        name: given(name, kind) if default is None else F.coalesce(given(name, kind), F.lit(default))
        for name, (kind, _, _, default) in RULES.items()
    }
    fields["has_major_event"] = F.coalesce(given("has_major_event", "boolean"), F.lit(False))
    fields["request_dt"] = cal.hour_bucket(given("request_dt", "timestamp_ntz"))
    typed = requests.withColumns(fields)
    bad = {"request_dt": F.col("request_dt").isNull()}
    for name, (_, low, high, _) in RULES.items():
        value = F.col(name)
        bad[name] = value.isNull() | (value < low) | (F.lit(False) if high is None else value > high)
    # Plain booleans, so that filtering on `accepted` never builds the list.
    return typed.withColumns(
        {
            "errors": F.array_compact(F.array(*[F.when(b, name) for name, b in bad.items()])),
            "accepted": ~reduce(lambda a, b: a | b, bad.values()),
        }
    )


def request_rows(
    accepted: DataFrame, keep: tuple[str, ...] = ("request_id",), monday_first: bool = False
) -> DataFrame:
    """Model input rows of accepted requests; history and indicators are unknown and sent as 0.

    The mart counts weekdays from Sunday = 0 and requests do too, so that a model
    meets the numbers it was trained on. ``monday_first`` counts from Monday = 0.
    """
    h, code = F.col("request_dt"), F.col("weather_code")
    weekday = F.weekday(h) if monday_first else cal.day_of_week(h)
    zero = ("demand_lag_24h", "demand_lag_168h", "unemployment_rate", "gas_price_avg", "consumer_sentiment")
    return accepted.select(
        *keep,
        "zone_id",
        "request_dt",
        cal.hour_of_day(h).alias("hour_of_day"),
        weekday.alias("day_of_week"),
        F.month(h).alias("month"),
        cal.is_weekend(h).alias("is_weekend"),
        "temperature_f",
        "feels_like_f",
        "precipitation_mm",
        "windspeed_mph",
        "humidity_pct",
        wx.is_raining(code).cast("int").alias("is_raining"),
        wx.is_snowing(code).cast("int").alias("is_snowing"),
        F.col("has_major_event").cast("int").alias("has_major_event"),
        "event_attendance",
        *[F.lit(0.0).alias(c) for c in zero],
    )
