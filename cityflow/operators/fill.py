"""Forward then backward fill of monthly values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_known(months: DataFrame, columns: tuple[str, ...]) -> Column:
    """A struct of the earliest value of each column, the fill of all months before it."""
    return F.struct(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("month_start"))).alias(c) for c in columns])


def fill_months(months: DataFrame, columns: tuple[str, ...], first: Column | None = None) -> DataFrame:
    """Fill gaps of a frame with one row per month (a calendar-bounded window).

    A month takes the last value known by then. Before the first one it takes ``first``, a struct by
    column that may come from a part of the data; by default the earliest value of all months.
    """
    back = W.orderBy("month_start").rowsBetween(W.unboundedPreceding, 0)
    if first is None:
        first = months.agg(first_known(months, columns).alias("f")).scalar()
    rows = months.withColumn("_first", first)
    return rows.select(
        "month_start",
        *[F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_first.{c}"), F.lit(0.0)).alias(c) for c in columns],
    )


def fill_economic(days: DataFrame, economics: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Indicators for every month in which `days.month_start` occurs, gaps filled."""
    present = days.select("month_start").distinct()
    return fill_months(present.join(economics.select("month_start", *columns), "month_start", "left"), columns)


def months_of(mart: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Indicators by month of a mart."""
    month = F.trunc(F.to_date("hour_bucket"), "MM")
    return mart.groupBy(month.alias("month_start")).agg(*[F.max(c).alias(c) for c in columns])


def fill_by_month(rows: DataFrame, mart: DataFrame, columns: tuple[str, ...], first: Column | None = None) -> DataFrame:
    """Fill indicator columns of `rows`, which were joined to `mart` by month.

    In time order the fill is a function of the month alone, so it runs on one
    row per month of the mart and is joined back.
    """
    keyed = rows.drop(*columns).withColumn("month_start", F.trunc(F.to_date("hour_bucket"), "MM"))
    return keyed.join(fill_months(months_of(mart, columns), columns, first), "month_start").drop("month_start")
