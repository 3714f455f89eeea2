import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cityflow import schemas
from cityflow.sources import civic, economic, quality, sinks, trips, weather

RAW = (
    "tpep_pickup_datetime TIMESTAMP_NTZ, tpep_dropoff_datetime TIMESTAMP_NTZ, PULocationID INT, DOLocationID INT, "
    "passenger_count INT, trip_distance DOUBLE, fare_amount DOUBLE, total_amount DOUBLE, payment_type INT"
)


def at(h, m=0):
    return datetime(2024, 1, 15, h, m)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [
            (at(8, 30), at(8, 45), 161, 163, 1, 1.5, 9.5, 12.0, 1),
            (at(9), at(9, 20), 162, 161, 2, 3.2, 15.0, 18.5, 2),
            (at(10), at(10, 15), 999, 160, 1, 2.0, 8.0, 10.5, 1),
            (at(11), at(11, 30), 0, 161, 1, 1.0, -5.0, 0.0, 1),
            (at(12), at(12, 5), 5, None, None, 1.0, 5.0, 6.0, None),
            (at(12), at(12, 5), 5, 6, 12, 1.0, 0.0, 6.0, 1),
            (at(12), at(12, 5), 5, 6, 1, 1.0, 501.0, 6.0, 1),
            (at(12), at(12, 5), 5, 6, 1, 101.0, 5.0, 6.0, 1),
            (None, at(12, 5), 5, 6, 1, 1.0, 5.0, 6.0, 1),
            (at(12), at(12, 5), 5, 6, 1, None, 5.0, 6.0, 1),
        ],
        RAW,
    )


def test_strict_rule(raw):
    rows = trips.clean_strict(raw).orderBy("pickup_dt", "fare_amount").collect()
    assert [(r.pickup_zone, r.fare_amount) for r in rows] == [(161, 9.5), (162, 15.0), (5, 0.0), (5, 5.0)]
    assert rows[2].passenger_cnt == 9
    assert (rows[3].dropoff_zone, rows[3].passenger_cnt, rows[3].payment_type) == (0, 1, 0)


def test_strict_rule_tolerates_missing_columns(raw):
    cleaned = trips.clean_strict(raw.drop("payment_type", "total_amount"))
    assert "payment_type" not in cleaned.columns and cleaned.count() == 4


def test_strict_types(raw):
    types = dict(trips.clean_strict(raw).dtypes)
    assert (types["pickup_zone"], types["dropoff_zone"], types["passenger_cnt"]) == ("smallint", "smallint", "tinyint")


def test_loader_rule(raw):
    rows = trips.clean_loader(raw).collect()
    assert len(rows) == 6  # zones and upper bounds are not checked, zero fares are dropped
    assert all(r.fare_amount > 0 and r.trip_distance > 0 for r in rows)


def test_month_files_with_changing_types(spark, raw, tmp_path):
    first, second = trips.month_paths(str(tmp_path), ("2024-01", "2024-02"))
    assert first.endswith("/yellow_tripdata_2024-01.parquet")
    raw.write.parquet(first)
    raw.withColumn("passenger_count", F.col("passenger_count").cast("double")).drop("payment_type").write.parquet(second)
    loaded = trips.scan_months(spark, [first, second])
    assert loaded.count() == 20
    assert dict(loaded.dtypes)["passenger_cnt"] == "bigint"
    counts = trips.rows_per_file(loaded).collect()
    assert sum(r["rows"] for r in counts) == 20


def test_scan_reads_mapped_columns_only(spark, raw, tmp_path):
    raw.withColumn("junk", F.lit("x")).write.parquet(f"{tmp_path}/m")
    plan = trips.scan_months(spark, [f"{tmp_path}/m"])._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan


WEATHER = """{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [30.5, 31.0],
"apparent_temperature": [28.0, 29.0], "precipitation": [0.0, 1.2], "windspeed_10m": [5.0, 6.0],
"relativehumidity_2m": [60, 65], "weathercode": [0, 61]}}"""


def test_weather_document(spark):
    parsed = weather.with_flags(weather.parse_weather(spark.createDataFrame([(WEATHER,)], "body STRING")))
    rows = parsed.orderBy("obs_dt").collect()
    assert [r.obs_dt for r in rows] == [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1)]
    assert [(r.weather_code, r.is_raining, r.is_snowing) for r in rows] == [(0, False, False), (61, True, False)]
    assert {"temperature_f", "feels_like_f", "precipitation_mm", "windspeed_mph", "humidity_pct"} <= set(parsed.columns)


def test_readers_return_the_declared_columns(spark):
    docs = spark.createDataFrame([("UNRATE", '{"observations": []}')], "series STRING, body STRING")
    for got, ddl in (
        (weather.parse_weather(spark.createDataFrame([(WEATHER,)], "body STRING")), schemas.WEATHER),
        (economic.align_series(economic.parse_observations(docs)), schemas.ECONOMICS),
        (civic.build_events(spark), schemas.EVENTS),
    ):
        assert got.dtypes == spark.createDataFrame([], ddl).dtypes


def test_economic_documents(spark):
    docs = spark.createDataFrame(
        [
            ("UNRATE", '{"observations": [{"date": "2024-01-01", "value": "3.7"}, {"date": "2024-02-01", "value": "."}]}'),
            ("CPIAUCSL", '{"observations": [{"date": "2024-02-01", "value": "309.7"}]}'),
        ],
        "series STRING, body STRING",
    )
    rows = economic.align_series(economic.parse_observations(docs)).orderBy("month_start").collect()
    assert [(r.month_start, r.unemployment_rate, r.cpi) for r in rows] == [
        (date(2024, 1, 1), 3.7, None),
        (date(2024, 2, 1), None, 309.7),
    ]


def test_built_in_events(spark):
    events = civic.build_events(spark)
    rows = events.collect()
    assert len(rows) == 11 and len({(r.event_date, r.event_name) for r in rows}) == 11
    assert all(r.est_attendance >= 0 and r.is_major in (True, False) for r in rows)
    assert [r.event_date for r in rows] == sorted(r.event_date for r in rows)


def test_user_events_lose_against_built_in_ones(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        "event_date,event_name,event_type,borough,est_attendance\n"
        "2024-11-04,NYC Marathon,sports,All,1\n2024-08-01,Street Fair,fair,Queens,\n"
    )
    rows = {r.event_name: r for r in civic.build_events(spark, str(path)).collect()}
    assert rows["NYC Marathon"].est_attendance == 55000
    assert (rows["Street Fair"].est_attendance, rows["Street Fair"].is_major) == (0, False)


def test_first_existing(spark, tmp_path):
    there = tmp_path / "sample.csv"
    there.write_text("x")
    assert civic.first_existing(spark, [str(tmp_path / "none.csv"), str(there)]) == str(there)
    assert civic.first_existing(spark, [str(tmp_path / "none.csv")]) is None


def test_upsert_keeps_stored_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace(spark.createDataFrame([(1, "old"), (2, "old")], "k INT, v STRING"), path)
    new = spark.createDataFrame([(2, "new"), (3, "b"), (3, "a")], "k INT, v STRING")
    sinks.upsert_new_rows(new, path, ["k"])
    sinks.upsert_new_rows(new, path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "old"), (2, "old"), (3, "a")]


def test_upsert_reads_only_the_units_it_can_touch(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "at TIMESTAMP_NTZ, v STRING"
    hours = lambda day, v: [(datetime(2024, 1, day, h), v) for h in range(24)]
    for day in range(1, 11):
        sinks.upsert_new_rows(spark.createDataFrame(hours(day, "old"), schema), path, ["at"], unit="DD")
    new = spark.createDataFrame(hours(4, "new") + hours(5, "new")[:3] + [(datetime(2024, 1, 5, 12, 30), "half")], schema)
    near = sinks.stored_near(new, path, ["at"], unit="DD")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert near.select(F.input_file_name().alias("f")).distinct().count() <= 2
    sinks.upsert_new_rows(new, path, ["at"], unit="DD")
    rows = sinks.read_keyed(spark, path)
    assert rows.columns == ["at", "v"] and rows.count() == 241
    assert {r.v: r["count"] for r in rows.groupBy("v").count().collect()} == {"old": 240, "half": 1}
    sinks.upsert_new_rows(new.limit(0), path, ["at"], unit="DD")
    assert sinks.read_keyed(spark, path).count() == 241


def test_footers_are_read_by_tasks(spark, tmp_path):
    kinds = ("int", "bigint", "double")
    paths = []
    for i in range(9):
        paths.append(str(tmp_path / f"yellow_tripdata_{i}.parquet"))
        row = spark.range(i + 1).select(F.col("id").cast(kinds[i % 3]).alias("PULocationID"), F.lit(1.5).alias("fare_amount"))
        row = row.withColumn("tpep_pickup_datetime", F.lit("2024-01-01").cast("timestamp_ntz"))
        row.coalesce(1).write.parquet(paths[-1])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("footers", "one job for all")
    found = trips.footer_schemas(spark, paths)
    jobs = tracker.getJobIdsForGroup("footers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 and len(set(found.values())) == 3
    for p in paths:
        assert StructType.fromJson(json.loads(found[p])).simpleString() == spark.read.parquet(p).schema.simpleString()
    rows = trips.scan_months(spark, paths)
    assert rows.count() == 45 and dict(rows.dtypes)["pickup_zone"] == "bigint"
    assert trips._footer("nowhere://x/y.parquet") is None and trips._footer(str(tmp_path / "none")) is None


def test_table_listing(spark):
    spark.range(1).createOrReplaceTempView("listed_view")
    names = [r.table_name for r in quality.table_listing(spark).collect()]
    assert "listed_view" in names
    spark.catalog.dropTempView("listed_view")


def test_constraints(spark):
    zones = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "zone_id INT, zone_name STRING")
    got = {r.rule: r.violations for r in quality.constraint_violations({"zones": zones}).collect()}
    assert got == {"zone_id is not null": 1, "unique (zone_id)": 1}
