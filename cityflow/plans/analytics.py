"""The analytic reports over the raw star.

Every report folds the trips to its join keys before a dimension is joined, so
what meets the dimension is bounded by calendar x zones, and a hot key is
folded map-side; the weather classes are the one exception, see there. Windows without a partition key only ever run over frames
with one row per day, month or report line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cityflow.functions import calendar as cal
from cityflow.functions import numbers as num
from cityflow.functions import weather as wx
from cityflow.operators.ordered import exact_quantiles
from cityflow.sources.store import settle

PICKUP = "pickup_dt"


def _hour() -> Column:
    return cal.hour_bucket(PICKUP).alias("hour_bucket")


def _share(n: str, alias: str) -> Column:
    return num.ratio_pct(F.col(n), F.sum(n).over(W.partitionBy()), 2).alias(alias)


def hourly_zone_demand(trips: DataFrame) -> DataFrame:
    measures = ("fare_amount", "trip_distance", "total_amount")
    return (
        trips.groupBy(_hour(), "pickup_zone")
        .agg(F.count("*").alias("trip_count"), *num.sums(*measures))
        .select(
            "hour_bucket",
            "pickup_zone",
            "trip_count",
            num.mean_of("fare_amount").alias("avg_fare"),
            num.mean_of("trip_distance").alias("avg_distance"),
            num.total_of("total_amount").alias("total_revenue"),
        )
        .orderBy("hour_bucket", F.desc("trip_count"), "pickup_zone")
    )


def hourly_city_demand(trips: DataFrame) -> DataFrame:
    return (
        trips.groupBy(_hour())
        .agg(F.count("*").alias("trip_count"), *num.sums("fare_amount", "total_amount"))
        .select(
            "hour_bucket",
            "trip_count",
            num.mean_of("fare_amount").alias("avg_fare"),
            num.total_of("total_amount").alias("revenue"),
        )
        .orderBy("hour_bucket")
    )


def grand_totals(trips: DataFrame) -> DataFrame:
    totals = trips.agg(F.count("*").alias("total_trips"), *num.sums("total_amount"))
    return totals.select("total_trips", num.total_of("total_amount").alias("total_revenue"))


def weather_impact(
    trips: DataFrame, weather: DataFrame, scheme: str, median_of: str
) -> DataFrame:
    """Trips, mean fare and distance, exact median and share per weather class.

    The median needs value counts per class. Hours are bounded by the calendar, so
    the planner broadcasts them by their measured bytes and trips fold map-side to
    (class, value); where it does not, adaptive execution splits a hot hour.
    """
    classes = weather.select(
        F.col("obs_dt").alias("hour_bucket"),
        wx.weather_class(F.col("weather_code"), scheme).alias("weather_category"),
    )
    measures = ("fare_amount", "trip_distance")
    folds = (F.count("trip_id").alias("n"), F.count("*").alias("rows"), *num.sums(*measures))
    value = F.col(median_of).alias("value")
    hourly = trips.withColumn("hour_bucket", _hour())
    per_value = settle(hourly.join(classes, "hour_bucket").groupBy("weather_category", value).agg(*folds), "class-values")
    known = per_value.filter(F.col("value").isNotNull())
    medians = exact_quantiles(known, ["weather_category"], "value", "rows", {"median": 0.5})
    totals = per_value.groupBy("weather_category").agg(F.sum("n").alias("total_trips"), *num.resums(*measures))
    return (
        totals.join(medians, "weather_category", "left")
        .select(
            "weather_category",
            "total_trips",
            num.mean_of("fare_amount").alias("avg_fare"),
            num.mean_of("trip_distance").alias("avg_distance"),
            F.round("median", 4).alias(f"median_{median_of}"),
            _share("total_trips", "pct_of_all_trips"),
        )
        .orderBy(F.desc("total_trips"), "weather_category")
    )


def daily_trips(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.to_date(PICKUP).alias("trip_date")).agg(F.count("*").alias("daily_trips"))


def event_deviation(trips: DataFrame, events: DataFrame, limit: int = 25) -> DataFrame:
    """Event days against the centred mean of the 15 surrounding days with trips."""
    around = W.orderBy("trip_date").rowsBetween(-7, 7)
    baseline = daily_trips(trips).withColumn("rolling_avg_14d", F.round(F.avg("daily_trips").over(around), 0))
    listed = events.filter(F.col("event_name").isNotNull()).select(
        F.col("event_date").alias("trip_date"), "event_name", "event_type", "est_attendance"
    )
    return (
        baseline.join(listed, "trip_date")
        .withColumn(
            "pct_deviation_from_baseline", num.change_pct(F.col("daily_trips"), F.col("rolling_avg_14d"))
        )
        .orderBy(F.desc_nulls_first("pct_deviation_from_baseline"), "trip_date", "event_name")
        .limit(limit)
    )


def zone_leaderboard(trips: DataFrame, zones: DataFrame, limit: int = 30) -> DataFrame:
    measures = ("fare_amount", "trip_distance", "total_amount")
    per_zone = trips.groupBy(F.col("pickup_zone").alias("zone_id")).agg(
        F.count("trip_id").alias("trip_count"), *num.sums(*measures)
    )
    named = (
        per_zone.join(zones.select("zone_id", "zone_name", "borough"), "zone_id")
        .groupBy("zone_name", "borough")
        .agg(F.sum("trip_count").alias("trip_count"), *num.resums(*measures))
    )
    return (
        named.select(
            "zone_name",
            "borough",
            "trip_count",
            num.total_of("total_amount").alias("total_revenue"),
            num.mean_of("fare_amount").alias("avg_fare"),
            num.mean_of("trip_distance").alias("avg_distance"),
            F.dense_rank().over(W.orderBy(F.desc("trip_count"))).alias("demand_rank"),
            F.dense_rank().over(W.orderBy(F.desc_nulls_first("total_amount_units"))).alias("revenue_rank"),
        )
        .orderBy("demand_rank", "zone_name", "borough")
        .limit(limit)
    )


def dow_hour_heatmap(trips: DataFrame) -> DataFrame:
    measures = ("fare_amount", "trip_distance")
    return (
        trips.groupBy(
            cal.day_of_week(PICKUP).alias("day_of_week"),
            cal.day_name(PICKUP).alias("day_name"),
            cal.hour_of_day(PICKUP).alias("hour_of_day"),
        )
        .agg(F.count("*").alias("trip_count"), *num.sums(*measures))
        .select(
            "day_of_week",
            "day_name",
            "hour_of_day",
            "trip_count",
            num.mean_of("fare_amount").alias("avg_fare"),
            num.mean_of("trip_distance").alias("avg_distance"),
        )
        .orderBy("day_of_week", "hour_of_day")
    )


def heatmap_pivot(trips: DataFrame) -> DataFrame:
    counts = trips.groupBy(
        cal.day_of_week(PICKUP).alias("day_of_week"), cal.hour_of_day(PICKUP).alias("hour_of_day")
    ).agg(F.count("*").alias("n"))
    wide = counts.groupBy("day_of_week").pivot("hour_of_day", list(range(24))).sum("n")
    return wide.select(
        "day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)]
    ).orderBy("day_of_week")


def _event_neighbours(days: DataFrame, order: Column) -> DataFrame:
    w = W.orderBy(*order)
    return days.withColumn("trips_day_before", F.lag("trips_event_day").over(w)).withColumn(
        "trips_day_after", F.lead("trips_event_day").over(w)
    )


def _event_report(days: DataFrame) -> DataFrame:
    now, before, after = (F.col(c) for c in ("trips_event_day", "trips_day_before", "trips_day_after"))
    return days.select(
        "event_date",
        "event_name",
        "est_attendance",
        "trips_day_before",
        "trips_event_day",
        "trips_day_after",
        num.change_pct(now, before).alias("pct_change_vs_prior_day"),
        num.change_pct(after, now).alias("pct_change_next_day"),
    ).orderBy("event_date", "event_name")


def event_before_after(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Major-event days; the neighbours are the previous and next major-event day."""
    major = events.filter("is_major").select("event_date", "event_name", "est_attendance")
    daily = daily_trips(trips).select(
        F.col("trip_date").alias("event_date"), F.col("daily_trips").alias("trips_event_day")
    )
    joined = major.join(daily, "event_date")
    return _event_report(_event_neighbours(joined, ("event_date", "event_name")))


def event_before_after_calendar(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Major-event days; the neighbours are the calendar days before and after."""
    major = events.filter("is_major").select("event_date", "event_name", "est_attendance")
    day_number = F.unix_date("event_date")
    at = lambda n: W.orderBy(day_number).rangeBetween(n, n)
    daily = (
        daily_trips(trips)
        .select(F.col("trip_date").alias("event_date"), F.col("daily_trips").alias("trips_event_day"))
        .withColumn("trips_day_before", F.max("trips_event_day").over(at(-1)))
        .withColumn("trips_day_after", F.max("trips_event_day").over(at(1)))
    )
    return _event_report(major.join(daily, "event_date"))


def _monthly(trips: DataFrame, *measures: str) -> DataFrame:
    """Sums by month, of trips or of trips already folded to months (with column `month`)."""
    if "month" in trips.columns:
        return trips.groupBy("month").agg(F.sum("trips").alias("trips"), *num.resums(*measures))
    return trips.groupBy(cal.month_start(PICKUP).alias("month")).agg(
        F.count("*").alias("trips"), *num.sums(*measures)
    )


def monthly_revenue_mom(trips: DataFrame) -> DataFrame:
    """Monthly revenue and growth; a mean fare is added where trips carry fares."""
    measures = tuple(c for c in ("total_amount", "fare_amount") if {c, f"{c}_units"} & set(trips.columns))
    w = W.orderBy("month")
    fares = [num.mean_of("fare_amount").alias("avg_fare")] if "fare_amount" in measures else []
    return (
        _monthly(trips, *measures)
        .select("month", "trips", num.total_of("total_amount").alias("revenue"), *fares)
        .withColumn("prev_month_revenue", F.lag("revenue").over(w))
        .withColumn("revenue_mom_growth_pct", num.change_pct(F.col("revenue"), F.col("prev_month_revenue")))
        .orderBy("month")
    )


def monthly_cumulative(trips: DataFrame) -> DataFrame:
    w = W.orderBy("month")
    months = _monthly(trips, "total_amount")
    return (
        months.select(
            "month",
            F.col("trips").alias("monthly_trips"),
            num.total_of("total_amount").alias("monthly_revenue"),
            F.sum("trips").over(w).alias("cumulative_trips"),
            F.round(F.sum("total_amount_units").over(w).cast("double") / float(10 ** num.SCALE["total_amount"]), 2).alias("cumulative_revenue"),
            F.lag("trips").over(w).alias("prev_month_trips"),
        )
        .withColumn(
            "mom_trip_growth_pct", num.change_pct(F.col("monthly_trips"), F.col("prev_month_trips"))
        )
        .orderBy("month")
    )


def zone_rain_share(
    trips: DataFrame, weather: DataFrame, zones: DataFrame, min_trips: int = 1000, limit: int = 20
) -> DataFrame:
    """Rainy against dry trips per zone; a trip without a known flag counts in neither."""
    counts = trips.groupBy(_hour(), F.col("pickup_zone").alias("zone_id")).agg(F.count("trip_id").alias("n"))
    flags = weather.select(
        F.col("obs_dt").alias("hour_bucket"), wx.is_raining(F.col("weather_code")).alias("rain")
    )
    return (
        counts.join(flags, "hour_bucket")
        .groupBy("zone_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("rain"), F.col("n")).otherwise(0)).alias("rainy"),
            F.sum(F.when(~F.col("rain"), F.col("n")).otherwise(0)).alias("clear"),
        )
        .join(zones.select("zone_id", "zone_name", "borough"), "zone_id")
        .groupBy("zone_name", "borough")
        .agg(
            F.sum("n").alias("n"),
            F.sum("rainy").alias("rainy_trips"),
            F.sum("clear").alias("clear_trips"),
        )
        .filter(F.col("n") > min_trips)
        .select(
            "zone_name",
            "borough",
            "rainy_trips",
            "clear_trips",
            num.ratio_pct(F.col("rainy_trips"), F.col("n"), 1).alias("rainy_trip_pct"),
        )
        .orderBy(F.desc_nulls_first("rainy_trip_pct"), "zone_name", "borough")
        .limit(limit)
    )


def precipitation_buckets(trips: DataFrame, weather: DataFrame) -> DataFrame:
    measures = ("fare_amount", "trip_distance")
    per_hour = trips.groupBy(_hour()).agg(F.count("trip_id").alias("n"), *num.sums(*measures))
    obs = weather.select(F.col("obs_dt").alias("hour_bucket"), "precipitation_mm")
    return (
        per_hour.join(obs, "hour_bucket")
        .groupBy(wx.precipitation_bucket(F.col("precipitation_mm")).alias("precipitation_bucket"))
        .agg(
            F.sum("n").alias("total_trips"),
            F.min("precipitation_mm").alias("_least"),
            *num.resums(*measures),
        )
        .select(
            "precipitation_bucket",
            "total_trips",
            num.mean_of("fare_amount").alias("avg_fare"),
            _share("total_trips", "pct_of_trips"),
            num.mean_of("trip_distance").alias("avg_distance"),
            "_least",
        )
        .orderBy("_least")
        .drop("_least")
    )


def weekly_running_total(trips: DataFrame) -> DataFrame:
    w = W.partitionBy("pickup_zone").orderBy("week_start")
    return (
        trips.groupBy(cal.week_start(PICKUP).alias("week_start"), "pickup_zone")
        .agg(F.count("*").alias("weekly_trips"))
        .withColumn("cumulative_trips", F.sum("weekly_trips").over(w))
        .withColumn("week_number", F.row_number().over(w))
        .orderBy("pickup_zone", "week_start")
    )


def top_od_pairs(trips: DataFrame, zones: DataFrame, min_trips: int = 100, limit: int = 30) -> DataFrame:
    measures = ("trip_distance", "fare_amount")
    flows = (
        trips.filter(F.col("pickup_zone") != F.col("dropoff_zone"))
        .groupBy("pickup_zone", "dropoff_zone")
        .agg(F.count("*").alias("n"), *num.sums(*measures))
    )
    pickup = zones.select(
        F.col("zone_id").alias("pickup_zone"),
        F.col("zone_name").alias("pickup_zone_name"),
        F.col("borough").alias("pickup_borough"),
    )
    dropoff = zones.select(
        F.col("zone_id").alias("dropoff_zone"),
        F.col("zone_name").alias("dropoff_zone_name"),
        F.col("borough").alias("dropoff_borough"),
    )
    names = ("pickup_zone_name", "dropoff_zone_name", "pickup_borough", "dropoff_borough")
    return (
        flows.join(pickup, "pickup_zone")
        .join(dropoff, "dropoff_zone")
        .groupBy(*names)
        .agg(F.sum("n").alias("trip_count"), *num.resums(*measures))
        .filter(F.col("trip_count") > min_trips)
        .select(
            *names,
            "trip_count",
            num.mean_of("trip_distance").alias("avg_distance"),
            num.mean_of("fare_amount").alias("avg_fare"),
        )
        .orderBy(F.desc("trip_count"), *names)
        .limit(limit)
    )


def _day_events(events: DataFrame, *columns: str) -> DataFrame:
    """Event list with its repeats counted, so joining it after the fold stays exact."""
    return events.groupBy("event_date", *columns).agg(F.count("*").alias("_copies"))


def hour_context(
    trips: DataFrame, weather: DataFrame, events: DataFrame, economics: DataFrame
) -> DataFrame:
    """City-wide hours with weather, every listed event of the day, and indicators."""
    per_hour = (
        trips.groupBy(_hour())
        .agg(F.count("trip_id").alias("n"), *num.sums("fare_amount"))
        .withColumn("event_date", F.to_date("hour_bucket"))
        .withColumn("month_start", cal.month_start(F.col("hour_bucket")))
    )
    code = F.col("weather_code")
    obs = weather.select(
        F.col("obs_dt").alias("hour_bucket"),
        "temperature_f",
        "precipitation_mm",
        "windspeed_mph",
        wx.is_raining(code).alias("rain"),
        wx.is_snowing(code).alias("snow"),
    )
    econ = economics.select("month_start", "unemployment_rate", "gas_price_avg")
    return (
        per_hour.join(obs, "hour_bucket", "left")
        .join(_day_events(events, "event_name", "est_attendance"), "event_date", "left")
        .join(econ, "month_start", "left")
        .select(
            "hour_bucket",
            (F.col("n") * F.coalesce("_copies", F.lit(1))).alias("trip_count"),
            num.mean_of("fare_amount").alias("avg_fare"),
            "temperature_f",
            "precipitation_mm",
            "windspeed_mph",
            wx.condition(F.col("rain"), F.col("snow")).alias("weather_type"),
            F.coalesce("event_name", F.lit("None")).alias("event"),
            F.coalesce("est_attendance", F.lit(0)).alias("event_attendance"),
            "unemployment_rate",
            "gas_price_avg",
        )
        .orderBy("hour_bucket", "event")
    )


def hour_zone_context(
    trips: DataFrame, zones: DataFrame, weather: DataFrame, events: DataFrame, economics: DataFrame
) -> DataFrame:
    """Hours per zone with names, weather, every listed event of the day, and indicators."""
    per_hour = (
        trips.groupBy(_hour(), F.col("pickup_zone").alias("zone_id"))
        .agg(F.count("trip_id").alias("n"), *num.sums("total_amount"))
        .withColumn("event_date", F.to_date("hour_bucket"))
        .withColumn("month_start", cal.month_start(F.col("hour_bucket")))
    )
    obs = weather.select(F.col("obs_dt").alias("hour_bucket"), "temperature_f", "precipitation_mm")
    econ = economics.select("month_start", "unemployment_rate", "gas_price_avg")
    copies = F.coalesce("_copies", F.lit(1))
    return (
        per_hour.join(zones.select("zone_id", "zone_name", "borough"), "zone_id", "left")
        .join(obs, "hour_bucket", "left")
        .join(_day_events(events, "event_name", "is_major"), "event_date", "left")
        .join(econ, "month_start", "left")
        .withColumn("total_amount_units", F.col("total_amount_units") * copies)
        .select(
            "hour_bucket",
            "zone_id",
            "zone_name",
            "borough",
            (F.col("n") * copies).alias("trip_count"),
            num.total_of("total_amount").alias("revenue"),
            "temperature_f",
            "precipitation_mm",
            F.coalesce("event_name", F.lit("None")).alias("event_name"),
            F.coalesce(F.col("is_major").cast("string"), F.lit("false")).alias("is_major_event"),
            "unemployment_rate",
            "gas_price_avg",
        )
        .orderBy("hour_bucket", F.desc("trip_count"), "zone_id", "event_name")
    )


def demand_by_hour(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("hour_of_day")
        .agg(
            F.round(F.avg("trip_count"), 6).alias("avg_trips"),
            F.round(F.stddev_samp("trip_count"), 6).alias("std_trips"),
        )
        .orderBy("hour_of_day")
    )


def temperature_bins(mart: DataFrame, min_rows: int = 10) -> DataFrame:
    """Mean demand per 10 degree bin; bin edges round half to even."""
    return (
        mart.filter(F.col("temperature_f").between(-20, 120))
        .groupBy((F.rint(F.col("temperature_f") / 10.0) * 10).alias("temp_bin"))
        .agg(F.round(F.avg("trip_count"), 6).alias("avg_trips"), F.count("*").alias("n_hours"))
        .filter(F.col("n_hours") > min_rows)
        .orderBy("temp_bin")
    )


def demand_by_weather(mart: DataFrame) -> DataFrame:
    return (
        mart.filter(F.col("weather_code").isNotNull())
        .groupBy(wx.weather_class(F.col("weather_code"), "basic").alias("weather_type"))
        .agg(F.round(F.avg("trip_count"), 6).alias("avg_trips"), F.count("*").alias("n_obs"))
        .orderBy(F.desc("avg_trips"), "weather_type")
    )


def data_range(mart: DataFrame) -> DataFrame:
    return mart.agg(F.min("hour_bucket").alias("dt_min"), F.max("hour_bucket").alias("dt_max"))


def zone_hourly_series(mart: DataFrame, zone: int, start: str, end: str) -> DataFrame:
    """Demand of one zone from `start` to midnight of `end`, both included."""
    h = F.col("hour_bucket")
    return (
        mart.filter((F.col("zone_id") == zone) & h.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        .select("hour_bucket", "trip_count")
        .orderBy("hour_bucket")
    )


def top_zone_filter(mart: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows of the listed zones only."""
    return mart.join(zones.select("zone_id"), "zone_id", "left_semi")


def zone_name_lookup(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Attach the zone name; an unknown zone keeps its row with no name."""
    return rows.join(zones.select("zone_id", "zone_name"), "zone_id", "left")
