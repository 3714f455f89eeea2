"""Hourly weather documents: one JSON object with parallel arrays per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.functions import weather as wx

# Vendor name -> (table name, element type), fixed values.
FIELDS = {
    "temperature_2m": ("temperature_f", "double"),
    "apparent_temperature": ("feels_like_f", "double"),
    "precipitation": ("precipitation_mm", "double"),
    "windspeed_10m": ("windspeed_mph", "double"),
    "relativehumidity_2m": ("humidity_pct", "double"),
    "weathercode": ("weather_code", "int"),
}
DOCUMENT = "struct<hourly: struct<time: array<string>, " + ", ".join(
    f"{k}: array<{t}>" for k, (_, t) in FIELDS.items()
) + ">>"


def parse_weather(documents: DataFrame, column: str = "body") -> DataFrame:
    """One row per hour; the arrays of a document are zipped by position."""
    hourly = F.from_json(F.col(column), DOCUMENT)["hourly"]
    zipped = F.arrays_zip(hourly["time"].alias("time"), *[hourly[k].alias(k) for k in FIELDS])
    return documents.select(F.explode(zipped).alias("h")).select(
        F.to_timestamp_ntz(F.col("h.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("obs_dt"),
        *[F.col(f"h.{k}").alias(name) for k, (name, _) in FIELDS.items()],
    )


def with_flags(weather: DataFrame) -> DataFrame:
    """The generated rain and snow flags."""
    code = F.col("weather_code")
    return weather.withColumn("is_raining", wx.is_raining(code)).withColumn("is_snowing", wx.is_snowing(code))
