"""Incremental form of the load-and-refresh job.

New trip files are picked up by a file stream. Each micro-batch is cleaned and
appended to the trips table; its counts per hour and zone become a change table
of its own. The months that the changes name, late trips included, are merged: the
counts of these months are read, and only their folders are looked into, and
the mart rows of these months are rebuilt from counts. The cost of a batch
follows its own size and the calendar, not the trips or batches of the past.
A batch that is run again after a failure replaces its own rows, so a retry
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cityflow.functions import calendar as cal
from cityflow.plans.mart import hourly_counts
from cityflow.sources import sinks
from cityflow.sources.trips import clean_loader


def append_batch(trips: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's trips by pickup month, and its counts per hour and zone as the batch's change table and by
    month; a retry overwrites them. The trips are read twice, once for each."""
    spark, month = trips.sparkSession, cal.month_start(F.col("pickup_dt"))
    _write(trips.withColumns({"batch": F.lit(batch_id), "pickup_month": month}), f"{path}/trips")
    hourly_counts(trips).write.mode("overwrite").parquet(_changes(path, batch_id))
    counts = spark.read.parquet(_changes(path, batch_id))
    _write(counts.withColumns({"batch": F.lit(batch_id), "pickup_month": cal.month_start(F.col("hour_bucket"))}), f"{path}/counts")


def _changes(path: str, batch_id: int) -> str:
    return f"{path}/changes/batch={batch_id}"


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("pickup_month", "batch")
        .parquet(path)
    )


def touched_months(spark: SparkSession, path: str, batch_id: int) -> list[date]:
    """The months in which a batch has trips, from its own change table: one value per calendar month at most."""
    months = spark.read.parquet(_changes(path, batch_id)).select(cal.month_start(F.col("hour_bucket")).alias("m"))
    return sorted(r.m for r in months.distinct().collect())


def counts_of(spark: SparkSession, path: str, months: list[date]) -> DataFrame:
    """Counts per hour and zone of all batches in some months; no other month's folder is listed."""
    chosen = ",".join(sorted({f"{m:%Y-%m-%d}" for m in months}))
    stored = spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts/pickup_month={{{chosen}}}")
    return stored.groupBy("hour_bucket", "zone_id").agg(F.sum("trip_count").alias("trip_count"))


def _months_before(first: date, days: int) -> list[date]:
    """The first days of the months that the days ahead of a month lie in."""
    out, at = [], (first - timedelta(days=days)).replace(day=1)
    while at < first:
        out.append(at)
        at = (at + timedelta(days=32)).replace(day=1)
    return out


def refresh_touched(
    spark: SparkSession,
    path: str,
    mart_path: str,
    batch_id: int,
    build: Callable[[DataFrame], DataFrame],
    days_before: int = 0,
) -> None:
    """Merge a batch into the mart: rebuild the months in which it has trips from the counts of these months.

    ``build`` turns folded counts into mart rows. Where these look back (lags, trailing means),
    ``days_before`` days ahead of each month are read too, as the state carried into it, and left out of what is
    written.
    """
    touched = touched_months(spark, path, batch_id)
    if not touched:
        return
    day = F.to_date("hour_bucket")
    read, wanted = {*touched}, cal.month_start(F.col("hour_bucket")).isin(touched)
    for first in touched if days_before else ():
        read.update(_months_before(first, days_before))
        wanted |= (day < F.lit(first)) & (day >= F.lit(first - timedelta(days=days_before)))
    counts = counts_of(spark, path, sorted(read)).filter(wanted)
    built = build(counts).filter(cal.month_start(F.col("hour_bucket")).isin(touched))
    sinks.refresh_mart(built, mart_path, units=touched)


def start(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    path: str,
    mart_path: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame],
    clean: Callable[[DataFrame], DataFrame] = clean_loader,
    files_per_batch: int = 100,
    days_before: int = 0,
) -> StreamingQuery:
    """Process all files that have landed since the last run, then stop.

    `build` turns counts per hour and zone into mart rows, for example `ml_features` with its
    dimensions bound.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        append_batch(clean(batch), batch_id, path)
        refresh_touched(batch.sparkSession, path, mart_path, batch_id, build, days_before)

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
