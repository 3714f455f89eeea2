"""The model's feature matrix as column expressions.

``train`` rows take medians and trailing means from the data; ``serve`` rows
stand alone and take constants. The mode is explicit: a table of requests is
scored with serve rules however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflow.functions import calendar as cal
from cityflow.functions import numbers as num
from cityflow.operators.fill import fill_by_month, first_known, months_of
from cityflow.operators.lags import demand_history, overall_mean
from cityflow.operators.ordered import exact_quantiles
from cityflow.plans.mart import ECONOMIC_COLUMNS
from cityflow.plans.registry import MODEL_FEATURES
from cityflow.sources.store import settle

WEATHER_NUMBERS = ("temperature_f", "feels_like_f", "precipitation_mm", "windspeed_mph", "humidity_pct")
RUSH_HOURS = (7, 8, 9, 16, 17, 18, 19)
# Constants of the serve rules (fixed values).
SERVE_WEATHER = 60.0
SERVE_DEMAND = 200.0


def weather_medians(mart: DataFrame) -> DataFrame:
    """One row with the exact median of each weather column, a single struct `m`."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in WEATHER_NUMBERS]
    )
    folded = (
        mart.select(F.explode(pairs).alias("x"))
        .groupBy("x.name", "x.value")
        .agg(F.count("*").alias("n"))
        .filter(F.col("value").isNotNull())
    )
    medians = exact_quantiles(settle(folded, "weather-values"), ["name"], "value", "n", {"median": 0.5})
    return medians.agg(
        F.struct(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in WEATHER_NUMBERS]).alias("m")
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0))


def _shared(rows: DataFrame, keep: tuple[str, ...], demand: dict[str, Column]) -> DataFrame:
    """Expressions common to both modes; weather numbers are already free of nulls."""
    cycles = {}
    for short, column, period in (("hour", "hour_of_day", 24), ("dow", "day_of_week", 7), ("month", "month", 12)):
        cycles[f"{short}_sin"], cycles[f"{short}_cos"] = cal.cyclical(F.col(column), period)
    weekend, rain, snow = _flag("is_weekend"), _flag("is_raining"), _flag("is_snowing")
    windy = (F.col("windspeed_mph") > 20).cast("int")
    rush = ((weekend == 0) & F.coalesce(F.col("hour_of_day").isin(*RUSH_HOURS), F.lit(False))).cast("int")
    computed = {
        **cycles,
        "is_weekend": weekend,
        "is_rush_hour": rush,
        "is_raining": rain,
        "is_snowing": snow,
        "weather_severity": num.clip(snow * 3 + rain * 2 + windy, 0, 3).cast("int"),
        "has_major_event": _flag("has_major_event"),
        "event_attendance": F.coalesce(F.col("event_attendance").cast("double"), F.lit(0.0)),
        **demand,
    }
    matrix = [computed.get(c, F.col(c)).alias(c) for c in MODEL_FEATURES]
    return rows.select(*[c for c in keep if c not in MODEL_FEATURES], *matrix)


def _with_indicators(mart: DataFrame) -> DataFrame:
    absent = [c for c in ECONOMIC_COLUMNS if c not in mart.columns]
    return mart.withColumns({c: F.lit(None).cast("double") for c in absent})


def features_train(
    mart: DataFrame,
    keep: tuple[str, ...] = ("hour_bucket", "zone_id", "trip_count"),
    fitted_on: DataFrame | None = None,
    past_only: bool = False,
) -> DataFrame:
    """Feature matrix of mart rows.

    Every fill (weather medians, the mean demand that starts a zone, indicators of
    months before the first known one) comes from ``fitted_on``, the training part;
    by default from all rows. ``past_only`` keeps the row's own demand out of the
    trailing means; without it the means include the current row. A mart without
    indicator columns gets empty ones, which the fill turns into 0.0.
    """
    mart = _with_indicators(mart)
    source = mart if fitted_on is None else _with_indicators(fitted_on)
    rows = demand_history(mart, past_only).withColumn("_m", weather_medians(source).scalar())
    rows = rows.withColumns({c: F.coalesce(c, F.col(f"_m.{c}"), F.lit(0.0)) for c in WEATHER_NUMBERS})
    months = months_of(source, ECONOMIC_COLUMNS)
    first = months.agg(first_known(months, ECONOMIC_COLUMNS).alias("f")).scalar()
    rows = fill_by_month(rows.drop("_m"), mart, ECONOMIC_COLUMNS, first)
    recent, week = F.col("demand_recent_avg"), F.col("demand_rolling_7d_avg")
    if past_only:
        start = overall_mean(source)
        recent, week = F.coalesce(recent, start), F.coalesce(week, start)
    demand = {
        f"demand_lag_{n}h": F.coalesce(
            F.nullif(F.col(f"demand_lag_{n}h").cast("double"), F.lit(0.0)), recent
        )
        for n in (24, 168)
    }
    return _shared(rows, keep, {**demand, "demand_rolling_7d_avg": week})


def features_serve(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature matrix of stand-alone rows: constants replace what only history could tell."""
    present = set(rows.columns)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(SERVE_WEATHER)) for c in WEATHER_NUMBERS})
    rows = rows.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
            for c in ECONOMIC_COLUMNS
        }
    )
    demand = {
        c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(SERVE_DEMAND))
        if c in present
        else F.lit(SERVE_DEMAND)
        for c in ("demand_lag_24h", "demand_lag_168h")
    }
    return _shared(rows, keep, {**demand, "demand_rolling_7d_avg": F.lit(SERVE_DEMAND)})


def feature_nulls(matrix: DataFrame) -> DataFrame:
    """Nulls per model feature; every count must be zero."""
    counts = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"))
            for c in MODEL_FEATURES
        ]
    )
    return matrix.agg(counts.alias("r")).select(F.inline("r"))


def align_to(matrix: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns in training order; one that is absent becomes 0.0."""
    others = [c for c in matrix.columns if c not in names]
    return matrix.select(*others, *[F.col(c) if c in matrix.columns else F.lit(0.0).alias(c) for c in names])
