"""Historical-average predictor and prediction intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflow.operators.lags import overall_mean
from cityflow.operators.ordered import exact_quantiles
from cityflow.sources.store import settle

KEYS = ["zone_id", "hour_of_day", "day_of_week"]


def historical_average(train: DataFrame) -> DataFrame:
    return train.groupBy(*KEYS).agg(F.avg("trip_count").alias("avg_trips"))


def baseline_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean of the same zone, hour and weekday in training, else the training mean."""
    return (
        test.join(historical_average(train), KEYS, "left")
        .withColumn("prediction", F.coalesce("avg_trips", overall_mean(train)))
        .withColumnRenamed("trip_count", "actual")
        .drop("avg_trips")
    )


def served_trips(raw: Column) -> Column:
    """Whole, non-negative trips; ties go to the even number."""
    return F.greatest(F.lit(0), F.bround(raw, 0).cast("bigint"))


def prediction_interval(raw: Column, sigma_share: float = 0.15, z: float = 1.28) -> tuple[Column, Column]:
    """80 % band with a spread proportional to the prediction, cut to whole trips, never negative."""
    spread = raw * F.lit(sigma_share) * F.lit(z)
    low, high = (raw - spread).cast("bigint"), (raw + spread).cast("bigint")
    return F.greatest(F.lit(0), low), F.greatest(F.lit(0), high)


def residual_bands(validation: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Residual quantiles per zone from rows with `actual` and `prediction`.

    Residuals are folded at six digits so that equal ones share a row.
    """
    folded = (
        validation.withColumn("residual", F.round(F.col("actual") - F.col("prediction"), 6))
        .groupBy("zone_id", "residual")
        .agg(F.count("*").alias("n"))
    )
    return exact_quantiles(settle(folded, "residuals"), ["zone_id"], "residual", "n", {"q_low": low, "q_high": high})


def interval_calibrated(predictions: DataFrame, bands: DataFrame) -> DataFrame:
    """Interval from the zone's residual quantiles; a zone without residuals has none."""
    joined = predictions.join(bands, "zone_id", "left")
    return joined.select(
        *predictions.columns,
        F.greatest(F.lit(0.0), F.col("prediction") + F.col("q_low")).alias("interval_low"),
        F.greatest(F.lit(0.0), F.col("prediction") + F.col("q_high")).alias("interval_high"),
    )
