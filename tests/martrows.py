"""Rows of the mart for unit tests."""

MART_SCHEMA = (
    "hour_bucket TIMESTAMP_NTZ, zone_id INT, trip_count BIGINT, hour_of_day INT, day_of_week INT, month INT, "
    "is_weekend INT, temperature_f DOUBLE, feels_like_f DOUBLE, precipitation_mm DOUBLE, windspeed_mph DOUBLE, "
    "humidity_pct DOUBLE, weather_code INT, is_raining INT, is_snowing INT, has_major_event INT, "
    "event_attendance BIGINT, unemployment_rate DOUBLE, gas_price_avg DOUBLE, consumer_sentiment DOUBLE"
)


def mart_row(hour, **changes):
    """A mart row for a dry summer afternoon, with changes."""
    row = dict(
        hour_bucket=hour, zone_id=161, trip_count=280, hour_of_day=hour.hour, day_of_week=(hour.weekday() + 1) % 7,
        month=hour.month, is_weekend=int(hour.weekday() >= 5), temperature_f=78.5, feels_like_f=80.0,
        precipitation_mm=0.0, windspeed_mph=8.2, humidity_pct=65.0, weather_code=1, is_raining=0, is_snowing=0,
        has_major_event=0, event_attendance=0, unemployment_rate=3.8, gas_price_avg=3.65, consumer_sentiment=76.0,
    )
    return {**row, **changes}
