"""Regression metrics as one aggregation per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "mape", "r2")


def regression_metrics(rows: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """rmse, mae, mape (zero actuals ignored, NaN if there are no others) and r2."""
    y, p = F.col("actual").cast("double"), F.col("prediction")
    error = y - p
    sums = rows.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0.0))))).alias("ape"),
        F.var_pop(y).alias("variance"),
    )
    r2 = F.when(F.col("variance") > 0, 1 - F.try_divide(F.col("mse"), F.col("variance"))).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(
        *by,
        F.round(F.sqrt("mse"), digits).alias("rmse"),
        F.round("mae", digits).alias("mae"),
        F.coalesce(F.round(F.col("ape") * 100, digits), F.lit(float("nan"))).alias("mape"),
        F.round(r2, digits).alias("r2"),
    )


def error_sums(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """What the metrics are made of, per group: sums that can be added up over groups, batches or days."""
    y, p = F.col("actual").cast("double"), F.col("prediction")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(y != 0, 1)).alias("n_nonzero"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"),
        F.sum((y - p) * (y - p)).alias("squared"), F.sum(F.abs(y - p)).alias("absolute"),
        F.sum(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))).alias("shares"),
    )


def metrics_of_sums(sums: DataFrame, by: tuple[str, ...], digits: int = 6) -> DataFrame:
    """The metrics of ``regression_metrics`` and the number of rows, from error sums of any grouping finer than ``by``."""
    parts = ("n", "n_nonzero", "y", "yy", "squared", "absolute", "shares")
    whole = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in parts])
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r2 = F.when(spread > 0, 1 - F.col("squared") / spread).when(F.col("squared") == 0, 1.0).otherwise(0.0)
    return whole.select(
        *by, "n",
        F.round(F.sqrt(F.col("squared") / F.col("n")), digits).alias("rmse"),
        F.round(F.col("absolute") / F.col("n"), digits).alias("mae"),
        F.coalesce(F.round(F.try_divide("shares", "n_nonzero") * 100, digits), F.lit(float("nan"))).alias("mape"),
        F.round(r2, digits).alias("r2"),
    )


def model_comparison(rows: DataFrame) -> DataFrame:
    """One line per `model`, rounded for reading, best rmse first."""
    return (
        regression_metrics(rows, ("model",))
        .select(
            "model",
            F.round("rmse", 2).alias("rmse"),
            F.round("mae", 2).alias("mae"),
            F.round("mape", 2).alias("mape"),
            F.round("r2", 3).alias("r2"),
        )
        .orderBy("rmse", "model")
    )


def best_model(rows: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The model with the least rmse among those not excluded."""
    return (
        regression_metrics(rows.filter(~F.col("model").isin(*excluded)) if excluded else rows, ("model",))
        .orderBy("rmse", "model")
        .limit(1)
    )
