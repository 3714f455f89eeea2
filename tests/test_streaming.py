from datetime import date

import pytest
from pyspark.sql import functions as F

from cityflow.operators import lags
from cityflow.plans import mart
from cityflow.sources import bindings as b
from cityflow.sources import sinks
from cityflow.sources.trips import clean_loader
from cityflow.streaming import refresh


@pytest.fixture(scope="module")
def raw(spark, sf):
    """Raw trips spread over two months."""
    rows = b.raw_trips(spark, sf)
    later = F.when(F.col("trip_id") % 3 == 0, 40).otherwise(0)
    moved = {c: F.col(c) + F.make_dt_interval(days=later) for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}
    return rows.withColumns(moved)


def test_stream_equals_batch(spark, raw, tmp_path):
    landing, trips, table = (str(tmp_path / n) for n in ("landing", "trips", "mart"))
    args = (spark, landing, raw.schema, trips, table, str(tmp_path / "checkpoint"), mart.hourly_counts)
    raw.filter("trip_id % 2 = 0").coalesce(1).write.parquet(landing)
    refresh.start(*args, files_per_batch=1).awaitTermination(120)
    first = sinks.read_mart(spark, table).agg(F.sum("trip_count")).first()[0]
    raw.filter("trip_id % 2 = 1").coalesce(2).write.mode("append").parquet(landing)
    refresh.start(*args, files_per_batch=1).awaitTermination(120)
    want = mart.hourly_counts(clean_loader(raw))
    got = sinks.read_mart(spark, table).select(want.columns)
    assert 0 < first < want.agg(F.sum("trip_count")).first()[0]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_retried_batch_changes_nothing(spark, raw, tmp_path):
    trips, table = str(tmp_path / "trips"), str(tmp_path / "mart")
    cleaned = clean_loader(raw)
    for _ in range(2):
        refresh.append_batch(cleaned, 0, trips)
        refresh.refresh_touched(spark, trips, table, 0, mart.hourly_counts)
    assert sinks.read_mart(spark, table).agg(F.sum("trip_count")).first()[0] == cleaned.count()
    assert spark.read.parquet(f"{trips}/trips").count() == cleaned.count()


def test_lags_look_back_over_the_month(spark, raw, tmp_path):
    trips, table = str(tmp_path / "trips"), str(tmp_path / "mart")
    cleaned = clean_loader(raw)
    build = lambda counts: lags.calendar_lags(mart.hourly_counts(counts))
    whole = build(cleaned)
    february = F.col("hour_bucket") >= F.lit("2024-02-01").cast("timestamp_ntz")
    january = F.col("pickup_dt") < F.lit("2024-02-01").cast("timestamp_ntz")
    for i, part in enumerate((january, ~january)):
        refresh.append_batch(cleaned.filter(part), i, trips)
        refresh.refresh_touched(spark, trips, table, i, build, days_before=8)
    got = sinks.read_mart(spark, table).select(whole.columns)
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    assert got.where(february & F.col("demand_lag_168h").isNotNull()).count() > 0


def test_a_unit_without_rows_is_emptied(spark, raw, tmp_path):
    table = str(tmp_path / "mart")
    counts = mart.hourly_counts(clean_loader(raw))
    sinks.write_mart(counts, table)
    january = F.col("hour_bucket") < F.lit("2024-02-01").cast("timestamp_ntz")
    sinks.refresh_mart(counts.where("false"), table, units=[date(2024, 1, 1)])
    left = sinks.read_mart(spark, table)
    assert left.where(january).count() == 0 and left.count() == counts.where(~january).count()


def test_untouched_months_are_not_rewritten(spark, raw, tmp_path):
    trips, table = str(tmp_path / "trips"), str(tmp_path / "mart")
    cleaned = clean_loader(raw)
    january = F.col("pickup_dt") < F.lit("2024-02-01").cast("timestamp_ntz")
    refresh.append_batch(cleaned.filter(january), 0, trips)
    refresh.refresh_touched(spark, trips, table, 0, mart.hourly_counts)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "mart").rglob("*.parquet")}
    refresh.append_batch(cleaned.filter(~january), 1, trips)
    refresh.refresh_touched(spark, trips, table, 1, mart.hourly_counts)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items())
    assert sinks.read_mart(spark, table).agg(F.sum("trip_count")).first()[0] == cleaned.count()


def test_a_batch_reads_its_own_months_only(spark, raw, tmp_path):
    trips = str(tmp_path / "trips")
    cleaned = clean_loader(raw)
    january = F.col("pickup_dt") < F.lit("2024-02-01").cast("timestamp_ntz")
    refresh.append_batch(cleaned.filter(january), 0, trips)
    refresh.append_batch(cleaned.filter(~january), 1, trips)
    assert refresh.touched_months(spark, trips, 0) == [date(2024, 1, 1)]
    months = refresh.touched_months(spark, trips, 1)
    assert date(2024, 1, 1) not in months
    read = refresh.counts_of(spark, trips, [*months, date(1999, 1, 1)])
    assert not [f for f in read.inputFiles() if "2024-01-01" in f]
    assert read.agg(F.sum("trip_count")).first()[0] == cleaned.filter(~january).count()
    assert refresh._months_before(date(2024, 3, 1), 8) == [date(2024, 2, 1)]
    assert refresh._months_before(date(2024, 3, 1), 40) == [date(2024, 1, 1), date(2024, 2, 1)]
