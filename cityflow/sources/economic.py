"""Monthly series documents: a JSON list of dated observations per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column -> series code (fixed values).
SERIES = {
    "unemployment_rate": "UNRATE",
    "consumer_sentiment": "UMCSENT",
    "gas_price_avg": "GASREGCOVW",
    "cpi": "CPIAUCSL",
}
DOCUMENT = "struct<observations: array<struct<date: string, value: string>>>"


def parse_observations(documents: DataFrame, series: str = "series", column: str = "body") -> DataFrame:
    """(series, month_start, value) rows; "." marks a missing value and is skipped."""
    listed = F.from_json(F.col(column), DOCUMENT)["observations"]
    return (
        documents.select(F.col(series).alias("series"), F.explode(listed).alias("o"))
        .filter(F.col("o.value") != ".")
        .select(
            "series",
            F.to_date("o.date").alias("month_start"),
            F.col("o.value").try_cast("double").alias("value"),
        )
    )


def align_series(observations: DataFrame, names: dict[str, str] = SERIES) -> DataFrame:
    """One row per month that any series mentions, one column per series.

    A repeated observation of a month counts once, the largest value winning.
    """
    known = observations.filter(F.col("series").isin(*names.values()))
    wide = known.groupBy("month_start").pivot("series", list(names.values())).agg(F.max("value"))
    return wide.select("month_start", *[F.col(code).alias(name) for name, code in names.items()])
