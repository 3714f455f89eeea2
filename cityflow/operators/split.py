"""Temporal splits. Nothing is shuffled at random, no row window spans the table, and no split shuffles the mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cityflow.functions import calendar as cal


def temporal_split(mart: DataFrame, test_months: int = 2) -> DataFrame:
    """Label rows: the last months before the newest hour are the test part."""
    cutoff = cal.months_before(mart.agg(F.max("hour_bucket")).scalar(), test_months)
    return mart.withColumn("split", F.when(F.col("hour_bucket") <= cutoff, "train").otherwise("test"))


def _with_head(rows: DataFrame, counted: DataFrame, share: float) -> DataFrame:
    """Add `_head`: whether a row lies before the last `share` of the counted rows, in (hour, zone) order, nulls first.

    Each row is compared with one boundary. The boundary hour comes from counts per hour, the
    boundary zone from counts per zone inside that hour. Rows that share hour and zone go together.
    """
    cut = F.floor(counted.agg(F.count("*")).scalar().cast("double") * F.lit(1.0 - share))
    hour = _boundary(counted, "hour_bucket", cut)
    inside = counted.where(F.col("hour_bucket").eqNullSafe(hour["at"]))
    marked = rows.withColumns({"_hour": hour, "_zone": _boundary(inside, "zone_id", hour["rest"])})
    before = _before("hour_bucket", F.col("_hour")) | (
        F.col("hour_bucket").eqNullSafe(F.col("_hour.at")) & _before("zone_id", F.col("_zone"))
    )
    return marked.withColumn("_head", F.col("_hour").isNull() | before).drop("_hour", "_zone")


def _tail(mart: DataFrame, share: float, head: str, tail: str) -> DataFrame:
    return _with_head(mart, mart, share).withColumn("split", F.when(F.col("_head"), head).otherwise(tail)).drop("_head")


def _boundary(rows: DataFrame, name: str, cut: Column) -> Column:
    """(at, rest): the value whose rows hold position `cut`, and how many of them lie before it; null beyond the end."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))  # one row for each hour, or zone of an hour
    so_far = F.sum("n").over(W.orderBy(F.col(name).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("upto", so_far).withColumn("cut", cut.cast("bigint"))
    found = placed.where("upto - n <= cut and cut < upto")
    return found.select(F.struct(F.col(name).alias("at"), (F.col("cut") - F.col("upto") + F.col("n")).alias("rest"))).scalar()


def _before(name: str, boundary: Column) -> Column:
    """Whether a value comes before the boundary value, nulls first."""
    at = boundary["at"]
    return at.isNotNull() & (F.col(name).isNull() | F.coalesce(F.col(name) < at, F.lit(False)))


def fallback_split(mart: DataFrame, share: float = 0.2) -> DataFrame:
    """Label the last `share` of the rows in (hour, zone) order as the test part."""
    return _tail(mart, share, "train", "test")


def validation_tail(train: DataFrame, share: float = 0.1) -> DataFrame:
    """Label the last `share` of the training rows in (hour, zone) order as validation."""
    return _tail(train, share, "fit", "validation")


def three_parts(mart: DataFrame, test_months: int = 2, share: float = 0.1) -> DataFrame:
    """Label rows fit, validation (the last `share` of the training rows) and test (the last months)."""
    parted = temporal_split(mart, test_months)
    marked = _with_head(parted, parted.where("split = 'train'"), share)
    kept = F.when(F.col("_head"), "fit").otherwise("validation")
    return marked.withColumn("split", F.when(F.col("split") == "train", kept).otherwise("test")).drop("_head")
