"""The demand tables expressed over the driver's benchmark tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cityflow.functions import calendar as cal
from cityflow.functions import numbers as num
from cityflow.functions import weather as wx
from cityflow.session import pin
from cityflow.sources.store import stored


@dataclass(frozen=True)
class Tables:
    """The star: one fact and four dimensions, each with at most one row per key.

    The dimensions are loaded as stored tables on first use, as the ingest jobs
    leave them, so the planner knows their size.
    """

    spark: SparkSession
    sf_dir: str

    @property
    def trips(self) -> DataFrame:
        return trips(self.spark, self.sf_dir)

    @property
    def zones(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "zones", lambda: zones(self.spark, self.sf_dir))

    @property
    def weather(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "weather", lambda: weather(self.spark, self.sf_dir))

    @property
    def civic_events(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "civic-events", lambda: civic_events(self.spark, self.sf_dir))

    @property
    def economics(self) -> DataFrame:
        return economics(self.spark)


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table; its schema is inferred once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return pin(spark).read.schema(_schemas[path]).parquet(path)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").alias("pickup_dt"),
        (F.col("user_id") % 25).cast("int").alias("pickup_zone"),
        (F.col("event_id") % 25).cast("int").alias("dropoff_zone"),
        (F.col("event_id") % 6 + 1).cast("int").alias("passenger_cnt"),
        ((F.col("event_id") % 200).cast("double") / 10).alias("trip_distance"),
        F.col("value").alias("fare_amount"),
        F.round(F.col("value") * 1.2, 2).alias("total_amount"),
        F.when(kind == "purchase", 1)
        .when(kind == "signup", 2)
        .when(kind == "click", 3)
        .otherwise(4)
        .alias("payment_type"),
    )


def raw_trips(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """Trips as they arrive in a monthly file: vendor column names, holes and outliers."""
    eid = F.col("event_id")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        eid.alias("trip_id"),
        F.col("ts").alias("tpep_pickup_datetime"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(10))).alias("tpep_dropoff_datetime"),
        F.when(eid % 101 == 0, 999).otherwise(F.col("user_id") % 25).cast("int").alias("PULocationID"),
        F.when(eid % 13 != 0, eid % 25).cast("int").alias("DOLocationID"),
        F.when(eid % 17 != 0, eid % 12 + 1).cast("int").alias("passenger_count"),
        F.when(eid % 89 != 0, (eid % 200).cast("double") / 10).alias("trip_distance"),
        (F.col("value") - 5).alias("fare_amount"),
        F.round(F.col("value") * 1.2, 2).alias("total_amount"),
        F.when(kind == "purchase", 1).when(kind == "signup", 2).cast("int").alias("payment_type"),
        *extra,
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    return (
        read(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("zone_id"),
            F.col("n_name").alias("zone_name"),
            F.col("r_name").alias("borough"),
        )
    )


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    return (
        read(spark, sf_dir, "events")
        .select(cal.hour_bucket(F.col("ts")).alias("h"))
        .distinct()
        .withColumn("hx", (F.dayofmonth(h) - 1) * 24 + F.hour(h))
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the day-grain trips, numbered from 1992."""
    day = F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").select(day.cast("timestamp_ntz").alias("h")).distinct()
    return rows.withColumn("hx", F.datediff(F.to_date("h"), F.lit("1992-01-01").cast("date")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_of(hours(spark, sf_dir))


def weather_of(times: DataFrame) -> DataFrame:
    """One row per observed time; some are missing on purpose."""
    hx = F.col("hx")
    codes = F.array(*[F.lit(c) for c in (61, 0, 1, 2, 51, 3, 71, 95)])
    return (
        times.filter(hx % 97 != 0)
        .select(
            F.col("h").alias("obs_dt"),
            (F.lit(30.0) + (hx * 7 % 600).cast("double") / 10).alias("temperature_f"),
            (F.lit(28.0) + (hx * 7 % 600).cast("double") / 10).alias("feels_like_f"),
            F.when(hx % 4 == 0, (hx % 150).cast("double") / 10).otherwise(0.0).alias("precipitation_mm"),
            ((hx * 3 % 300).cast("double") / 10).alias("windspeed_mph"),
            (F.lit(30) + hx * 11 % 70).cast("double").alias("humidity_pct"),
            F.get(codes, hx % 8).alias("weather_code"),
        )
        .withColumn("is_raining", wx.is_raining(F.col("weather_code")))
        .withColumn("is_snowing", wx.is_snowing(F.col("weather_code")))
    )


def civic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(hours(spark, sf_dir))


def events_of(times: DataFrame) -> DataFrame:
    hx = F.col("hx")
    return (
        times.filter(hx % 120 == 0)
        .select(
            F.to_date("h").alias("event_date"),
            F.concat(F.lit("EVENT_"), F.floor(hx / 24).cast("string")).alias("event_name"),
            F.when(hx % 48 == 0, "parade").otherwise("sports").alias("event_type"),
            F.lit("All").alias("borough"),
            (hx * 1000).alias("est_attendance"),
            (hx % 48 == 0).alias("is_major"),
        )
    )


def civic_events_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list with a second, smaller event on one of the dates."""
    base = tables(spark, sf_dir).civic_events
    extra = base.filter(F.col("event_name") == "EVENT_10").select(
        "event_date",
        F.lit("EXTRA").alias("event_name"),
        F.lit("sports").alias("event_type"),
        "borough",
        F.lit(7000).alias("est_attendance"),
        F.lit(False).alias("is_major"),
    )
    return base.unionByName(extra)


def economics(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT month_start, unemployment_rate, consumer_sentiment, gas_price_avg, cpi
           FROM VALUES (DATE'2023-12-01', 3.7D, 69.7D, 3.1D, 307.7D),
                       (DATE'2024-01-01', 3.7D, 79.0D, 3.1D, 308.4D),
                       (DATE'2024-02-01', 3.9D, 76.9D, 3.2D, 309.7D)
                AS t(month_start, unemployment_rate, consumer_sentiment, gas_price_avg, cpi)"""
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(pin(spark), sf_dir)


def day_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain trips over 80 months, for monthly reports, splits and baselines."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        read(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("trip_id"),
            F.col("o_orderdate").alias("pickup_dt"),
            F.col("c_nationkey").alias("pickup_zone"),
            F.col("o_totalprice").alias("total_amount"),
        )
    )


def month_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain trips folded to (customer, month) before the customers are checked: no join moves a trip."""
    folded = (
        read(spark, sf_dir, "orders")
        .withColumnRenamed("o_totalprice", "total_amount")
        .groupBy("o_custkey", cal.month_start(F.col("o_orderdate")).alias("month"))
        .agg(F.count("*").alias("trips"), *num.sums("total_amount"))
    )
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return folded.join(known, "o_custkey", "left_semi").drop("o_custkey")


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly indicator table over the order months: some months and some values are missing."""
    m = F.year("month_start") * 12 + F.month("month_start")
    return (
        read(spark, sf_dir, "orders")
        .select(cal.month_start(F.col("o_orderdate")).alias("month_start"))
        .distinct()
        .filter(m % 7 != 3)
        .select(
            "month_start",
            F.when(m % 5 != 0, F.lit(3.0) + (m % 40).cast("double") / 10).alias("unemployment_rate"),
            F.when(m % 3 != 0, F.lit(60.0) + (m % 30).cast("double")).alias("consumer_sentiment"),
            F.when(m % 4 != 1, F.lit(2.0) + (m % 25).cast("double") / 10).alias("gas_price_avg"),
            F.lit(None).cast("double").alias("cpi"),
        )
    )
