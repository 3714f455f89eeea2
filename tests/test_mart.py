from datetime import date

import pytest
from pyspark.sql import functions as F

from cityflow import catalog
from cityflow.plans import analytics, mart
from cityflow.sources import bindings as b
from cityflow.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def star(spark, sf):
    return b.tables(spark, sf)


def test_no_trip_is_lost(spark, star):
    got = mart.ml_features(star.trips, star.weather, star.civic_events, star.economics)
    assert got.agg(F.sum("trip_count")).first()[0] == star.trips.count()
    assert got.count() == got.select("hour_bucket", "zone_id").distinct().count()


def test_fold_then_join_equals_join_then_fold(spark, sf, star):
    events = b.civic_events_fanout(spark, sf)
    # A repeated event and one without attributes must count as a plain join would.
    odd = events.limit(1).unionByName(
        events.limit(1).withColumns({"is_major": F.lit(None).cast("boolean"), "est_attendance": F.lit(None).cast("int")})
    )
    events = spark.createDataFrame(events.unionByName(odd).collect(), events.schema)
    mine = mart.ml_features(
        star.trips, star.weather, events, star.economics, ("hour_bucket", "zone_id", "trip_count", *mart.EVENT_COLUMNS),
        event_rows="as_listed",
    )
    joined = (
        star.trips.join(events, F.to_date("pickup_dt") == F.col("event_date"), "left")
        .groupBy(
            F.date_trunc("hour", "pickup_dt").cast("timestamp_ntz").alias("hour_bucket"),
            F.col("pickup_zone").alias("zone_id"),
            F.coalesce(F.col("is_major").cast("int"), F.lit(0)).alias("has_major_event"),
            F.coalesce(F.col("est_attendance").cast("bigint"), F.lit(0)).alias("event_attendance"),
        )
        .agg(F.count("*").alias("trip_count"))
        .select(mine.columns)
    )
    assert mine.exceptAll(joined).count() == 0 and joined.exceptAll(mine).count() == 0


def test_two_events_a_day_collapse(spark, sf, star):
    got = mart.ml_features(star.trips, star.weather, b.civic_events_fanout(spark, sf), star.economics)
    day = got.filter(F.to_date("hour_bucket") == F.lit(date(2024, 1, 11)))
    extra = b.civic_events(spark, sf).filter("event_name = 'EVENT_10'").first()
    assert {r.event_attendance for r in day.collect()} == {extra.est_attendance + 7000}


def test_mart_plan(spark, star):
    got = mart.ml_features(star.trips, star.weather, star.civic_events, star.economics)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # One shuffle on the trip side, one for the folded events; no dimension forces another.
    assert plan.count("Exchange hashpartitioning(hour") + plan.count("Exchange hashpartitioning(_groupingexpression") <= 1
    assert "PushedFilters" in plan and "props" not in plan


def test_unused_dimensions_are_not_joined(star):
    got = mart.ml_features(star.trips, star.weather, star.civic_events, star.economics, ("hour_of_day", "trip_count"))
    assert "Join" not in plan_of(got)


def test_period_filter_reaches_the_scan(spark, sf, star):
    early = star.trips.filter(F.col("pickup_dt") < F.lit("2024-01-05").cast("timestamp_ntz"))
    assert "LessThan(ts" in plan_of(mart.hourly_counts(early))


def test_refresh_touches_only_its_units(spark, sf, star, tmp_path):
    path = str(tmp_path / "mart")
    counts = mart.hourly_counts(star.trips)
    sinks.write_mart(counts, path, unit="DD")
    late = F.col("hour_bucket") >= F.lit("2024-01-20").cast("timestamp_ntz")
    sinks.refresh_mart(counts.filter(late).withColumn("trip_count", F.col("trip_count") * 2), path, unit="DD")
    got = sinks.read_mart(spark, path)
    want = counts.withColumn("trip_count", F.when(late, F.col("trip_count") * 2).otherwise(F.col("trip_count")))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    part = sinks.read_mart(spark, path, "2024-01-03", "2024-01-05", unit="DD")
    assert part.agg(F.countDistinct(F.to_date("hour_bucket"))).first()[0] == 2
    assert "mart_unit" in plan_of(part).split("PartitionFilters")[1]


def test_median_survives_a_hot_class(spark):
    """One weather class holds nearly all trips; both join orders equal the native percentile."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    hour = F.when(F.col("id") % 50 == 0, F.col("id") % 24).otherwise(3).cast("int")
    trips = spark.range(20_000).select(
        F.col("id").alias("trip_id"),
        (start + F.make_dt_interval(hours=hour)).alias("pickup_dt"),
        (F.abs(F.xxhash64("id") % 5000) / 100).alias("trip_distance"),
        F.lit(9.5).alias("fare_amount"),
    )
    weather = spark.range(24).select(
        (start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("obs_dt"),
        F.when(F.col("id") == 3, 61).otherwise(0).cast("int").alias("weather_code"),
    )
    got = analytics.weather_impact(trips, weather, "impact", "trip_distance").collect()
    joined = trips.join(weather, F.date_trunc("hour", "pickup_dt").cast("timestamp_ntz") == F.col("obs_dt"))
    want = {
        r[0]: (r[1], r[2])
        for r in joined.groupBy(F.when(F.col("weather_code") == 61, "Rain").otherwise("Clear"))
        .agg(F.count("*"), F.round(F.median("trip_distance"), 4))
        .collect()
    }
    assert {r.weather_category: (r.total_trips, r.median_trip_distance) for r in got} == want


def test_sums_do_not_depend_on_partitions(spark, sf, star):
    one = analytics.zone_leaderboard(star.trips.repartition(1), star.zones).collect()
    many = analytics.zone_leaderboard(star.trips.repartition(13), star.zones).collect()
    assert one == many


def test_top_zones(spark, star):
    from cityflow.sources.zones import TOP_ZONES, top_zones

    counts = mart.hourly_counts(star.trips).withColumn("zone_id", F.col("zone_id") + 155)
    got = analytics.top_zone_filter(counts, top_zones(spark))
    assert {r.zone_id for r in got.select("zone_id").distinct().collect()} == {z for z in TOP_ZONES if 155 <= z < 180}


@pytest.mark.parametrize(
    "key", ["ml_features", "weather_impact", "top_od_pairs", "hour_zone_context", "features_train", "drift_numeric"]
)
def test_shuffled_joins_give_the_same_rows(spark, sf, key):
    """With broadcasting off every join shuffles; the rows stay the same."""
    want = sorted(map(str, catalog.QUERIES[key](spark, sf).collect()))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        assert sorted(map(str, catalog.QUERIES[key](spark, sf).collect())) == want
    finally:
        for name in names:
            spark.conf.unset(name)


def test_shuffles_are_sized_and_never_shrunk(spark, sf, monkeypatch):
    from cityflow import session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    table = b.read(spark, sf, "events")
    try:
        assert session.size_shuffles(table) == int(before)
        monkeypatch.setattr(session, "SHUFFLE_BYTES", 10_000)
        wide = session.size_shuffles(table)
        assert int(before) < wide
        monkeypatch.setattr(session, "SHUFFLE_BYTES", 1)
        assert session.size_shuffles(table) > wide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
