"""Declared schemas and rules of the loaded tables. Timestamps are wall clock without a zone."""

from __future__ import annotations

WEATHER = (
    "obs_dt TIMESTAMP_NTZ, temperature_f DOUBLE, feels_like_f DOUBLE, precipitation_mm DOUBLE, "
    "windspeed_mph DOUBLE, humidity_pct DOUBLE, weather_code INT"
)
EVENTS = (
    "event_date DATE, event_name STRING, event_type STRING, borough STRING, "
    "est_attendance INT, is_major BOOLEAN"
)
ECONOMICS = (
    "month_start DATE, unemployment_rate DOUBLE, consumer_sentiment DOUBLE, "
    "gas_price_avg DOUBLE, cpi DOUBLE"
)

# Columns that must be present, the unique key, per table.
NOT_NULL = {
    "trips": ("trip_id", "pickup_dt", "dropoff_dt", "pickup_zone"),
    "weather": ("obs_dt",),
    "civic_events": ("event_date",),
    "economics": ("month_start",),
    "zones": ("zone_id",),
}
UNIQUE_KEY = {
    "trips": ("trip_id",),
    "weather": ("obs_dt",),
    "civic_events": ("event_date", "event_name"),
    "economics": ("month_start",),
    "zones": ("zone_id",),
}
