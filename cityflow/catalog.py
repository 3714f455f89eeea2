"""Every report and operator bound to the benchmark tables, one callable per key."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cityflow.functions import calendar as cal
from cityflow.functions import numbers as num
from cityflow.functions import weather as wx
from cityflow.operators import baseline, drift, fill, lags, metrics, ordered, sampling, split
from cityflow.operators.boosting import Boosted
from cityflow.plans import analytics, features, mart, monitoring, requests, scoring, training
from cityflow.plans.registry import MODEL_FEATURES
from cityflow.session import pin, scratch
from cityflow.sources import bindings as b
from cityflow.sources import civic, economic, quality, sinks, trips, weather
from cityflow.sources.store import settle, stored

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the keys, repeated in the oracles.
MIN_ZONE_TRIPS = 100
MIN_OD_TRIPS = 10
ZONE, START, END = 5, "2024-01-03", "2024-01-20"
REFERENCE, CURRENT = ("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31")
REFRESH_FROM = "2024-01-20"
COUNTS = ("hour_bucket", "zone_id", "trip_count")
INDICATORS_FROM = "1995-01-01"
MISSING = ("humidity_pct", "demand_lag_168h")


def stored_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The mart table that reports, features and models read; built once per application."""
    table = stored(pin(spark), sf, "mart", lambda: ml_features(spark, sf), sinks.write_mart)
    return table.select(*mart.MART_COLUMNS)


def time_mart(spark: SparkSession, sf: str) -> DataFrame:
    return stored_mart(spark, sf).select(*COUNTS, *mart.TIME_COLUMNS)


def day_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The mart of the day-grain trips over 80 months, all columns, stored like the hourly mart."""

    def build() -> DataFrame:
        days = stored(pin(spark), sf, "days", lambda: b.days(spark, sf))
        return mart.ml_features(
            b.day_trips(spark, sf), b.weather_of(days), b.events_of(days), b.monthly_series(spark, sf)
        )

    return stored(pin(spark), sf, "day-mart", build)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns so that both engines show the same digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shown(query: Query, **types: str) -> Query:
    """Present dates as midnight timestamps, and the named columns with the given types."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        want = {**{c: "timestamp_ntz" for c, t in df.dtypes if t == "date"}, **types}
        return df.select(*[F.col(c).cast(want[c]).alias(c) if c in want else F.col(c) for c in df.columns])

    return run


# ---- sources, sinks, quality --------------------------------------------------


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = b.tables(spark, sf)
    return quality.table_counts(
        {
            "taxi_trips": t.trips,
            "taxi_zones": t.zones,
            "weather_hourly": t.weather,
            "civic_events": t.civic_events,
            "economic_indicators": t.economics,
        }
    )


def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    t = b.tables(spark, sf)
    raw = trips.rename_known(b.raw_trips(spark, sf), extra=("trip_id",))
    return quality.constraint_violations(
        {
            "trips": raw.withColumn("trip_id", F.floor(F.col("trip_id") / 2)),
            "zones": t.zones,
            "weather": t.weather,
            "civic_events": b.civic_events_fanout(spark, sf).drop("event_name").withColumn("event_name", F.col("event_type")),
            "economics": b.monthly_series(spark, sf).unionByName(b.monthly_series(spark, sf).where("month_start < '1993-01-01'")),
        }
    )


def generated_weather_flags(spark: SparkSession, sf: str) -> DataFrame:
    w = weather.with_flags(b.weather(spark, sf).drop("is_raining", "is_snowing"))
    return w.select("obs_dt", "weather_code", "is_raining", "is_snowing")


def weather_code_names(spark: SparkSession, sf: str) -> DataFrame:
    w = b.weather(spark, sf)
    return w.select("obs_dt", "weather_code", wx.code_name(F.col("weather_code")).alias("description"))


def weather_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document per day, as the archive service would send it."""
    w = b.weather(spark, sf)
    rows = w.groupBy(F.to_date("obs_dt").alias("day")).agg(
        F.array_sort(
            F.collect_list(F.struct("obs_dt", *[F.col(n).alias(k) for k, (n, _) in weather.FIELDS.items()]))
        ).alias("r")
    )
    stamp = F.transform("r", lambda x: F.date_format(x["obs_dt"], "yyyy-MM-dd'T'HH:mm"))
    hourly = F.struct(stamp.alias("time"), *[F.col("r")[k].alias(k) for k in weather.FIELDS])
    return rows.select(F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))


def weather_from_json(spark: SparkSession, sf: str) -> DataFrame:
    return weather.parse_weather(weather_documents(spark, sf))


def economic_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document per series over the order months; a gap is written as '.'."""
    months = b.monthly_series(spark, sf)
    long = months.select(
        "month_start",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(code).alias("series"), F.col(name).alias("value"))
                    for name, code in economic.SERIES.items()
                ]
            )
        ).alias("s"),
    )
    entry = F.struct(
        F.col("month_start").cast("string").alias("date"),
        F.coalesce(F.col("s.value").cast("string"), F.lit(".")).alias("value"),
    )
    docs = long.groupBy(F.col("s.series").alias("series")).agg(F.array_sort(F.collect_list(entry)).alias("observations"))
    return docs.select("series", F.to_json(F.struct("observations")).alias("body"))


def economic_from_json(spark: SparkSession, sf: str) -> DataFrame:
    return economic.align_series(economic.parse_observations(economic_documents(spark, sf)))


def upsert_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Weather rows that an insert-if-absent would add to a table holding every third hour."""
    w = b.weather(spark, sf).drop("is_raining", "is_snowing")
    stored = w.filter(F.hour("obs_dt") % 3 == 0)
    again = w.withColumn("temperature_f", F.col("temperature_f") + 1)
    return sinks.absent_rows(w.unionByName(again), stored, ["obs_dt"])


def upserted_table(spark: SparkSession, sf: str) -> DataFrame:
    """Weather kept by day, after two overlapping loads of which the second one repeats hours with other values."""
    w, path = b.weather(spark, sf).drop("is_raining", "is_snowing"), scratch(spark, "weather-by-day")
    sinks.upsert_new_rows(w.filter(F.dayofmonth("obs_dt") <= 12), path, ["obs_dt"], unit="DD")
    later = w.filter(F.dayofmonth("obs_dt") >= 10).withColumn("temperature_f", F.col("temperature_f") + 1)
    sinks.upsert_new_rows(later, path, ["obs_dt"], unit="DD")
    return sinks.read_keyed(spark, path)


def events_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists with repeats; the first list wins."""
    first = b.civic_events_fanout(spark, sf)
    second = b.civic_events(spark, sf).withColumns(
        {
            "est_attendance": F.col("est_attendance") + 5,
            "event_name": F.when(F.col("is_major"), F.col("event_name")).otherwise(F.lit("RERUN")),
            "is_major": F.lit(None).cast("boolean"),
        }
    )
    return civic.combine([first, second])


def _events_file(spark: SparkSession, sf: str) -> str:
    """The landed list of events, with empty fields."""
    events = b.civic_events_fanout(spark, sf)
    path = scratch(spark, "events-csv")
    events.select(
        F.col("event_date").cast("string").alias("event_date"),
        "event_name",
        "event_type",
        "borough",
        F.when(F.col("is_major"), F.col("est_attendance")).alias("est_attendance"),
        F.when(F.col("is_major"), F.lit("true")).alias("is_major"),
    ).write.option("header", True).csv(path)
    return path


def civic_events_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines written as CSV text and read back with defaults for empty fields."""
    return civic.read_csv(spark, _events_file(spark, sf))


def events_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The list of a second place, as the first one holds no file."""
    path = civic.first_existing(spark, [scratch(spark, "events-absent"), _events_file(spark, sf)])
    return civic.read_csv(spark, path)


def events_with_curated(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in lists and the landed one."""
    return civic.build_events(spark, _events_file(spark, sf))


def appended_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips by zone and payment of a table to which two loads were appended."""
    rows, path = b.trips(spark, sf), scratch(spark, "appended")
    for part in (0, 1):
        sinks.append(rows.where(F.col("trip_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("pickup_zone", "payment_type").agg(F.count("*").alias("n_trips"))


def replaced_events(spark: SparkSession, sf: str) -> DataFrame:
    """What a table holds after a second list has replaced the first."""
    path = scratch(spark, "replaced")
    sinks.replace(b.civic_events_fanout(spark, sf), path)
    sinks.replace(b.civic_events(spark, sf), path)
    return spark.read.parquet(path)


def reloaded_events(spark: SparkSession, sf: str) -> DataFrame:
    """A table emptied and loaded again, its numbers starting over."""
    path = scratch(spark, "reloaded")
    for rows in (b.civic_events(spark, sf), b.civic_events_fanout(spark, sf)):
        sinks.reload(rows, path, "event_id", ["event_date", "event_name"])
    return spark.read.parquet(path)


def ordered_mart(spark: SparkSession, sf: str) -> DataFrame:
    """All mart counts in order, each with the hour of the row before it."""
    path = scratch(spark, "ordered-mart")
    sinks.write_mart(stored_mart(spark, sf), path)
    rows = sinks.read_ordered(spark, path).select(*COUNTS)
    return rows.withColumn("previous_hour", F.lag("hour_bucket").over(W.partitionBy("zone_id").orderBy("hour_bucket")))


def recent_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """The stored indicators from a month on; the bound reaches the scan."""
    path = scratch(spark, "indicators")
    sinks.replace(b.monthly_series(spark, sf), path)
    return sinks.read_from(spark, path, "month_start", INDICATORS_FROM).drop("cpi")


def malformed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Values of an event file that are no numbers and no flags."""
    path = scratch(spark, "events-malformed")
    b.civic_events_fanout(spark, sf).select(
        F.col("event_date").cast("string").alias("event_date"),
        "event_name",
        "event_type",
        "borough",
        F.when(F.col("is_major"), F.col("est_attendance").cast("string")).otherwise("many").alias("est_attendance"),
        F.when(F.col("event_type") == "sports", "maybe").otherwise("true").alias("is_major"),
    ).write.option("header", True).csv(path)
    return civic.malformed(spark, path)


def clean_trips(rule: Callable) -> Query:
    return lambda spark, sf: rule(b.raw_trips(spark, sf), extra=("trip_id",))


def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = trips.clean_for_sample(b.raw_trips(spark, sf), extra=("trip_id",))
    return sampling.every_nth(cleaned, "trip_id", 6)


def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.trips(spark, sf).select("trip_id", "pickup_dt", "pickup_zone", "fare_amount")
    return sampling.seeded_sample(rows, "trip_id", 2000)


_landed: dict[tuple[str, str], list[str]] = {}


def landed_files(spark: SparkSession, sf: str) -> list[str]:
    """Three deliveries of ten days each, under vendor file names and with numeric types that differ; written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _landed:
        folder, part = scratch(pin(spark), "landing"), F.floor((F.dayofmonth("tpep_pickup_datetime") - 1) / 10)
        paths = trips.month_paths(folder, ("2024-01", "2024-02", "2024-03", "2024-04"))
        for i, path in enumerate(paths):
            kind = ("int", "bigint", "double", "int")[i]
            rows = b.raw_trips(spark, sf).where(part == i)
            rows.withColumns({c: F.col(c).cast(kind) for c in ("PULocationID", "passenger_count")}).write.parquet(path)
        _landed[key] = paths
    return _landed[key]


def month_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded rows of each landed file."""
    raw = trips.scan_months(spark, landed_files(spark, sf))
    counts = trips.rows_per_file(trips.clean_loader(raw, extra=("source_file",)))
    return counts.withColumnsRenamed({"rows": "n_rows"})


def loaded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a bulk load of all landed files adds."""
    raw = trips.scan_months(spark, landed_files(spark, sf))
    return trips.clean_loader(raw, extra=("source_file",)).agg(F.count("*").alias("loaded_rows"))


_stale: dict[tuple[str, str], str] = {}


def stale_mart(spark: SparkSession, sf: str) -> str:
    """A stored mart whose last days miss half their trips; written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stale:
        _stale[key] = scratch(pin(spark), "stale-mart")
        t = b.tables(spark, sf)
        late = F.col("pickup_dt") >= F.lit(REFRESH_FROM).cast("timestamp_ntz")
        partial = t.trips.filter(~late | (F.col("trip_id") % 2 == 0))
        rows = mart.ml_features(partial, t.weather, t.civic_events, t.economics)
        sinks.write_mart(rows, _stale[key], unit="DD")
    return _stale[key]


def mart_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The stale days of a stored mart are built anew, all columns, and the mart is read back."""
    path, t = stale_mart(spark, sf), b.tables(spark, sf)
    late = t.trips.filter(F.col("pickup_dt") >= F.lit(REFRESH_FROM).cast("timestamp_ntz"))
    sinks.refresh_mart(mart.ml_features(late, t.weather, t.civic_events, t.economics), path, unit="DD")
    return sinks.read_mart(spark, path)


def amount_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and means of amounts with four decimals, some of them missing, NaN, infinite or too large."""
    e = F.col("event_id")
    amount = (
        F.when(e % 50 == 0, float("nan"))
        .when(e % 50 == 1, float("inf"))
        .when(e % 50 == 2, 1e300)
        .when(e % 50 != 3, (e * 7919 % 1000003).cast("double") / 10000)
    )
    rows = b.read(spark, sf, "events").select("event_type", amount.alias("total_amount"))
    found = rows.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), num.unusable("total_amount").alias("n_unusable"), *num.sums("total_amount")
    )
    return found.select(
        "event_type", "n_rows", "n_unusable", F.col("total_amount_n").alias("n_amounts"),
        num.total_of("total_amount", 4).alias("total"), num.mean_of("total_amount", 4).alias("mean"),
    )


def _dropoffs(spark: SparkSession, sf: str) -> DataFrame:
    return trips.rename_known(b.raw_trips(spark, sf)).where("fare_amount is not null")


def dropoff_fare_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median fare of raw trips by drop-off zone; trips without a zone are a group of their own."""
    folded = _dropoffs(spark, sf).groupBy("dropoff_zone", "fare_amount").agg(F.count("*").alias("n"))
    found = ordered.exact_quantiles(settle(folded, "fares"), ["dropoff_zone"], "fare_amount", "n", {"median": 0.5})
    return found.select("dropoff_zone", F.round("median", 4).alias("median_fare"))


def residual_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Deciles of the baseline's residuals by zone."""
    rows = baseline.baseline_predictions(*_train_test(spark, sf))
    return rounded(baseline.residual_bands(rows), 4)


# ---- mart and reports ---------------------------------------------------------


def ml_features(spark: SparkSession, sf: str) -> DataFrame:
    t = b.tables(spark, sf)
    return mart.ml_features(t.trips, t.weather, t.civic_events, t.economics)


def ml_features_fanout(spark: SparkSession, sf: str) -> DataFrame:
    t = b.tables(spark, sf)
    return mart.ml_features(
        t.trips, t.weather, b.civic_events_fanout(spark, sf), t.economics, event_rows="as_listed"
    )


def with_trips(report: Callable, *dimensions: str, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = b.tables(spark, sf)
        return report(t.trips, *[getattr(t, d) for d in dimensions], **options)

    return run


def with_months(report: Callable) -> Query:
    return lambda spark, sf: report(b.month_amounts(spark, sf))


def on_mart(report: Callable, *args) -> Query:
    return lambda spark, sf: report(stored_mart(spark, sf), *args)


def ml_features_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The mart variant with row lags, in which unknown weather leaves the flags empty."""
    t = b.tables(spark, sf)
    rows = mart.ml_features(t.trips, t.weather, t.civic_events, t.economics, unknown_weather=None)
    return lags.row_lags(rows)


def top_zone_filter(spark: SparkSession, sf: str) -> DataFrame:
    chosen = b.zones(spark, sf).filter(F.col("borough").isin("ASIA", "EUROPE"))
    return analytics.top_zone_filter(time_mart(spark, sf), chosen)


def zone_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = trips.clean_loader(b.raw_trips(spark, sf), extra=("trip_id",))
    rows = cleaned.select("trip_id", F.col("pickup_zone").alias("zone_id"))
    return analytics.zone_name_lookup(rows, b.zones(spark, sf))


# ---- lags, features -----------------------------------------------------------


def counts_of(spark: SparkSession, sf: str) -> DataFrame:
    return stored_mart(spark, sf).select(*COUNTS)


def on_counts(operator: Callable) -> Query:
    return lambda spark, sf: rounded(operator(counts_of(spark, sf)))


def fill_economic(spark: SparkSession, sf: str) -> DataFrame:
    days = b.read(spark, sf, "orders").select(cal.month_start(F.col("o_orderdate")).alias("month_start"))
    return fill.fill_economic(days, b.monthly_series(spark, sf), mart.ECONOMIC_COLUMNS)


def features_train(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.features_train(stored_mart(spark, sf)))


def request_rows_monday(spark: SparkSession, sf: str) -> DataFrame:
    """Request rows with weekdays counted from Monday = 0."""
    accepted = requests.validate_requests(prediction_requests(spark, sf)).filter("accepted")
    return requests.request_rows(accepted, monday_first=True)


def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    """Serving rows that miss two columns, in training order."""
    return features.align_to(features_serve(spark, sf).drop(*MISSING), MODEL_FEATURES)


def features_serve(spark: SparkSession, sf: str) -> DataFrame:
    accepted = requests.validate_requests(prediction_requests(spark, sf)).filter("accepted")
    return rounded(features.features_serve(requests.request_rows(accepted), keep=("request_id",)))


def feature_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_nulls(features.features_train(stored_mart(spark, sf)))


# ---- requests -----------------------------------------------------------------


def prediction_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The landed table of requests."""
    return stored(pin(spark), sf, "requests", lambda: derived_requests(spark, sf))


def derived_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per event; some miss fields, some break the ranges."""
    e = F.col("event_id")
    codes = F.array(*[F.lit(c) for c in (61, 0, 1, 2, 51, 3, 71, 95)])
    warm = F.lit(30.0) + (e * 7 % 600).cast("double") / 10
    return b.read(spark, sf, "events").select(
        e.alias("request_id"),
        F.when(e % 101 == 0, 999).otherwise(F.col("user_id") % 25).cast("int").alias("zone_id"),
        F.col("ts").alias("request_dt"),
        F.when(e % 97 == 0, 9999.0).otherwise(warm).alias("temperature_f"),
        F.when(e % 113 != 0, warm + 2).alias("feels_like_f"),
        F.when(e % 89 == 0, -5.0).when(e % 4 == 0, (e % 150).cast("double") / 10).alias("precipitation_mm"),
        ((e * 3 % 300).cast("double") / 10).alias("windspeed_mph"),
        F.when(e % 11 != 0, (F.lit(30) + e * 11 % 70).cast("double")).alias("humidity_pct"),
        F.when(e % 211 == 0, 120).otherwise(F.get(codes, (e % 8).cast("int"))).alias("weather_code"),
        (F.col("event_type") == "purchase").alias("has_major_event"),
        F.when(e % 2 != 0, e % 1000).cast("int").alias("event_attendance"),
    )


def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    checked = requests.validate_requests(prediction_requests(spark, sf))
    return checked.withColumn("errors", F.concat_ws(",", "errors"))


def request_rows(spark: SparkSession, sf: str) -> DataFrame:
    checked = requests.validate_requests(prediction_requests(spark, sf))
    return requests.request_rows(checked.filter("accepted"))


def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with gaps, NaN and infinities made safe to show."""
    e, v = F.col("event_id"), F.col("value") / 7
    dirty = (
        F.when(e % 10 == 0, float("nan"))
        .when(e % 10 == 1, float("inf"))
        .when(e % 10 == 2, float("-inf"))
        .when(e % 10 != 3, v)
    )
    return b.read(spark, sf, "events").select("event_id", num.safe_float(dirty).alias("shown"))


# ---- splits, baseline, metrics ------------------------------------------------


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.temporal_split(day_mart(spark, sf)).select(*COUNTS, "split")


def fallback_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.fallback_split(counts_of(spark, sf))


def validation_tail(spark: SparkSession, sf: str) -> DataFrame:
    train = split.temporal_split(day_mart(spark, sf).select(*COUNTS)).filter("split = 'train'")
    return split.validation_tail(train.drop("split")).select(*COUNTS, "split")


def _train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = split.temporal_split(day_mart(spark, sf).select(*COUNTS, *mart.TIME_COLUMNS))
    return parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")


def historical_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(baseline.historical_average(time_mart(spark, sf)))


def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(baseline.baseline_predictions(*_train_test(spark, sf)))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression_metrics(baseline.baseline_predictions(*_train_test(spark, sf)))


def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions of three simple predictors on the hourly mart."""
    rows = lags.row_lags_filled(time_mart(spark, sf)).withColumnRenamed("trip_count", "actual")
    parts = [
        rows.select(F.lit(name).alias("model"), "actual", F.col(column).alias("prediction"))
        for name, column in (("same_hour_yesterday", "demand_lag_24h"), ("same_hour_last_week", "demand_lag_168h"))
    ]
    counts = time_mart(spark, sf)
    history = baseline.baseline_predictions(counts, counts)
    parts.append(history.select(F.lit("historical_average").alias("model"), "actual", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.model_comparison(model_predictions(spark, sf))


def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_model(model_predictions(spark, sf), excluded=("historical_average",))


def prediction_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = baseline.baseline_predictions(*_train_test(spark, sf))
    low, high = baseline.prediction_interval(F.col("prediction"))
    return rows.select(
        "hour_bucket",
        "zone_id",
        baseline.served_trips(F.col("prediction")).alias("predicted_trips"),
        low.alias("interval_low"),
        high.alias("interval_high"),
    )


def interval_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    parts = settle(split.validation_tail(train), "fit-validation")
    fit = parts.filter("split = 'fit'").drop("split")
    validation = parts.filter("split = 'validation'").drop("split")
    bands = baseline.residual_bands(baseline.baseline_predictions(fit, validation))
    scored = baseline.baseline_predictions(fit, test)
    return rounded(
        baseline.interval_calibrated(scored.select("hour_bucket", "zone_id", "actual", "prediction"), bands), 8
    )


# ---- drift --------------------------------------------------------------------

DRIFT_INPUT = ("hour_bucket", *monitoring.DRIFT_COLUMNS, monitoring.TARGET)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return drift.label_periods(stored_mart(spark, sf).select(*DRIFT_INPUT), REFERENCE, CURRENT)


def drift_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_numeric(_labelled(spark, sf), monitoring.NUMERIC)


def drift_categorical(spark: SparkSession, sf: str) -> DataFrame:
    counts = drift.label_periods(counts_of(spark, sf), REFERENCE, CURRENT)
    return drift.drift_categorical(counts, "zone_id")


def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_summary(_labelled(spark, sf), monitoring.NUMERIC, "zone_id")


# ---- models -------------------------------------------------------------------

_fitted: dict[tuple, object] = {}


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix of the day mart; `split` is fit, validation or test (two months), in time order.

    Trailing means look back over the split; every fill comes from the training part only.
    """
    parts = split.three_parts(day_mart(spark, sf))
    return features.features_train(
        parts, keep=(*COUNTS, "split"), fitted_on=parts.filter("split <> 'test'"), past_only=True
    )


def features_fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix that models are fitted on, with its split."""
    return rounded(_matrix(spark, sf))


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training rows (fit and validation) and test rows of the stored matrix."""
    matrix = stored(pin(spark), sf, "matrix", lambda: _matrix(spark, sf))
    return matrix.filter("split <> 'test'"), matrix.filter("split = 'test'")


def _once(spark: SparkSession, sf: str, name: str, build: Callable):
    """What takes long to fit, kept for the application and the preset in use."""
    key = (spark.sparkContext.applicationId, sf, training.preset_of(spark), name)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


def _model(spark: SparkSession, sf: str, name: str) -> PipelineModel | Boosted:
    """A fitted model; `early_stopping` is boosting with patience, `tuned` the best trial."""
    return _timed(spark, sf, name)[0]


def _timed(spark: SparkSession, sf: str, name: str) -> tuple[PipelineModel | Boosted, float]:
    """The model and the seconds that its fit took; fitted once, for its own key and the run table."""
    train, _ = _stored(spark, sf)
    preset = training.preset_of(spark)

    def build() -> tuple[PipelineModel | Boosted, float]:
        started = time.monotonic()
        if name == "early_stopping":
            model = training.fit_early_stopping(train, preset=preset)
        elif name == "tuned":
            model = _trials(spark, sf)[1]
        else:
            model = training.fit(name, train.filter("split = 'fit'"), preset)
        return model, time.monotonic() - started

    return _once(spark, sf, name, build)


def _leaves(spark: SparkSession, sf: str, name: str):
    return _once(
        spark, sf, f"{name}-leaves", lambda: scoring.load_leaves(spark, _model(spark, sf, name), scratch(spark, "nodes"))
    )


def model_test_predictions(name: str) -> Query:
    """Fit a model on the training part and predict the test part."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = training.predictions(_model(spark, sf, name), _stored(spark, sf)[1])
        return found.select("hour_bucket", "zone_id", "actual", "prediction")

    return run


def predicted_rows(name: str) -> Query:
    """The rows that a model predicts, and whether each prediction is a number of trips."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = model_test_predictions(name)(spark, sf)
        return found.select("hour_bucket", "zone_id", "actual", (F.col("prediction") >= 0).alias("non_negative"))

    return run


# The search space of the small preset.
SMALL_SPACE = training.SPACE | {"rounds": (3, 6, "int"), "depth": (2, 4, "int")}


def _trials(spark: SparkSession, sf: str) -> tuple[list[training.Trial], Boosted]:
    """All trials of the search, best first, and the best model; the small preset has fewer rounds."""
    space = training.SPACE if training.preset_of(spark) == "full" else SMALL_SPACE
    train, _ = _stored(spark, sf)
    return _once(spark, sf, "trials", lambda: training.tune(train, space=space))


def hyperparameter_search(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(
        [
            (i, float(t.rmse), {k: str(v) for k, v in t.drawn.items()}, t.kept, t.run)
            for i, t in enumerate(_trials(spark, sf)[0])
        ],
        "place INT, rmse DOUBLE, params MAP<STRING, STRING>, kept_rounds INT, run_rounds INT",
    )


def search_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The search draws every parameter in each trial, lists trials in order of their error, and never runs more rounds
    than drawn, nor more than patience after the best one."""
    rows = hyperparameter_search(spark, sf)
    ahead = F.lag("rmse").over(W.orderBy("place"))
    in_order = F.coalesce(ahead <= F.col("rmse"), F.lit(True))
    drawn = F.col("params")["rounds"].cast("int")
    patient = F.col("run_rounds") == F.least(drawn, F.col("kept_rounds") + training.PATIENCE)
    all_drawn = F.size("params") == len(training.SPACE)
    return rows.select("place", all_drawn.alias("all_drawn"), in_order.alias("in_order"), patient.alias("patient"))


RUNS = ("linear", "random_forest", "random_forest_deep", "boosted_a", "boosted_b", "early_stopping")


# Order in which fits are begun, those that are one long task first, and how many run at a time.
LONGEST_FIRST, SIDE_BY_SIDE = ("boosted_a", "boosted_b", "early_stopping", "random_forest", "random_forest_deep", "linear"), 3


def _each_model(spark: SparkSession, sf: str, work: Callable) -> dict:
    """What ``work`` makes of each fitted model and the seconds of its fit, by name in the order of the run table.

    A few fits run side by side: rows that one task holds are boosted in that task, which leaves cores free.
    """
    _stored(spark, sf)  # written before the fits that read it
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        found = dict(zip(LONGEST_FIRST, pool.map(lambda name: work(name, *_timed(spark, sf, name)), LONGEST_FIRST)))
    return {name: found[name] for name in RUNS}


def _runs(spark: SparkSession, sf: str) -> list:
    """The baseline and every model, fitted, timed and measured on the same test part."""

    def build() -> list:
        _, test = _stored(spark, sf)
        days = day_mart(spark, sf).select(*COUNTS, "hour_of_day", "day_of_week")
        parts = split.temporal_split(days)
        plain = [parts.filter(f"split = '{p}'").drop("split") for p in ("train", "test")]
        fitted = _each_model(spark, sf, lambda name, model, seconds: training.measured(name, model, seconds, test))
        return [training.baseline_run(*plain), *fitted.values()]

    return _once(spark, sf, "runs", build)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The stored test predictions of the baseline and of every fitted model, one row per model and test row."""

    def build() -> str:
        _, test = _stored(spark, sf)
        path, keys = scratch(spark, "predictions"), ("hour_bucket", "zone_id", "actual", "prediction")
        days = split.temporal_split(day_mart(spark, sf).select(*COUNTS, "hour_of_day", "day_of_week"))
        plain = [days.filter(f"split = '{p}'").drop("split") for p in ("train", "test")]
        training.store_predictions(baseline.baseline_predictions(*plain).select(*keys), path, "historical_average", "first")
        for name, model in _each_model(spark, sf, lambda name, model, seconds: model).items():
            found = training.predictions(model, test).select(*keys)
            training.store_predictions(found, path, name, "first")
        return path

    return spark.read.parquet(_once(spark, sf, "predictions", build))


def stored_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """All models by their stored predictions: sums of each month are kept, and add up to the metrics of the run table."""
    month = F.date_trunc("month", "hour_bucket").alias("month")
    sums = settle(metrics.error_sums(_predictions(spark, sf).withColumn("month", month), ("model", "month")), "error-sums")
    return metrics.metrics_of_sums(sums, ("model",)).orderBy("rmse", "model")


def stored_comparison_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every model has a prediction for each test row; metrics from stored sums are those of the run table; the baseline's
    values are those that SQL finds."""
    logged = run_log(spark, sf).select("model", *[F.col(m).alias(f"run_{m}") for m in metrics.METRICS])
    close = [F.abs(F.col(m) - F.col(f"run_{m}")) <= 1e-4 * (1 + F.abs(F.col(m))) for m in metrics.METRICS]
    shown_of = lambda m: F.round(F.when(F.col("model") == "historical_average", F.col(m)), 4).alias(m)
    both = stored_comparison(spark, sf).join(logged, "model")
    return both.select("model", "n", reduce(lambda a, b: a & b, close).alias("agrees"), *[shown_of(m) for m in ("rmse", "mae")])


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Train, measure, append the runs to the stored log (one load twice), keep the best model as an artifact and load it again."""
    runs, path = _runs(spark, sf), scratch(spark, "artifact")
    training.save_artifact(spark, path, training.best_run(runs, excluded=("historical_average",)), runs)
    _, about = training.load_artifact(spark, path)
    log = f"{path}/log"
    # A load that is retried adds nothing twice.
    for some, run_id in ((runs[:1], "baseline"), (runs[1:], "models"), (runs[1:], "models")):
        training.append_runs(spark, some, log, run_id)
    return training.read_runs(spark, log).withColumn("best", F.col("model") == about["model"])


def run_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every run is logged once, with its error and time; one model is best, and never the baseline."""
    return run_log(spark, sf).select(
        "model", (F.col("rmse") > 0).alias("measured"), (F.col("train_s") >= 0).alias("timed"),
        (F.col("best") & (F.col("model") == "historical_average")).alias("baseline_best"),
        F.sum(F.col("best").cast("int")).over(W.partitionBy()).alias("n_best"),
    )


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return training.feature_importance(spark, _model(spark, sf, "random_forest"))


def forecast_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast of one zone over its first 336 test hours."""
    _, test = _stored(spark, sf)
    zone = test.filter(F.col("zone_id") == ZONE).orderBy("hour_bucket").limit(336)
    return training.predictions(_model(spark, sf, "boosted_a"), zone).select("hour_bucket", "actual", "prediction")


# The model that answers requests: boosting with patience, as published.
SERVED = "early_stopping"


def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_requests(
        prediction_requests(spark, sf),
        b.zones(spark, sf),
        _model(spark, sf, SERVED),
        _leaves(spark, sf, SERVED),
        training.VERSION,
    )


def _explained(spark: SparkSession, sf: str, name: str = "boosted_a") -> DataFrame:
    _, test = _stored(spark, sf)
    return scoring.explained(test, _model(spark, sf, name), _leaves(spark, sf, name))


def tree_attributions(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
        return _explained(spark, sf, name).select(
            "hour_bucket", "zone_id", "contributions", "base_value", "raw_prediction",
            F.round(total + F.col("base_value") - F.col("raw_prediction"), 6).alias("gap"),
        )

    return run


def global_importance(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.global_importance(_explained(spark, sf))


def dependence_data(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.dependence_data(_explained(spark, sf), "temperature_f", ("hour_bucket", "zone_id"))


def dependence_bins(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.dependence_bins(_explained(spark, sf), "temperature_f", 5.0)


def local_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """The first test row of one zone on a Friday (weekday 5), at the hour that day-grain rows have."""
    _, test = _stored(spark, sf)
    chosen = (F.col("zone_id") == ZONE) & (F.hour("hour_bucket") == 0) & (cal.day_of_week(F.col("hour_bucket")) == 5)
    row = test.filter(chosen).orderBy("hour_bucket").limit(1)
    return scoring.local_waterfall(
        scoring.explained(row, _model(spark, sf, "boosted_a"), _leaves(spark, sf, "boosted_a"))
    )


# ---- facts about the keys above that SQL can state ------------------------------


def importance_facts(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"feature_importance": feature_importance, "global_importance": global_importance}
    rows = [
        q(spark, sf).agg(F.lit(k).alias("report"), F.count("*").alias("n_rows"), F.countDistinct("feature").alias("n_features"))
        for k, q in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_vs_actual(spark, sf).select("hour_bucket", "actual", F.col("prediction").isNotNull().alias("forecast"))


def scored_requests(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.get("confidence_interval", F.lit(0)), F.get("confidence_interval", F.lit(1))
    return batch_scoring(spark, sf).select(
        "request_id", "zone_name", F.size("top_factors").alias("n_factors"),
        ((low >= 0) & (low <= high) & (low <= F.col("predicted_trips"))).alias("banded"),
    )


def attribution_gaps(name: str) -> Query:
    """Contributions and base value add up to the prediction, for every test row."""
    return lambda spark, sf: tree_attributions(name)(spark, sf).select(
        "hour_bucket", "zone_id", F.size("contributions").alias("n_features"), (F.col("gap") == 0).alias("adds_up")
    )


def dependence_values(spark: SparkSession, sf: str) -> DataFrame:
    found = dependence_data(spark, sf)
    return found.select("hour_bucket", "zone_id", F.round("value", 6).alias("value"), F.col("shap_value").isNotNull().alias("explained"))


def dependence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dependence_bins(spark, sf).select(F.col("bin").cast("double").alias("bin"), "n")


def waterfall_facts(spark: SparkSession, sf: str) -> DataFrame:
    keys = local_waterfall(spark, sf).groupBy("hour_bucket", "zone_id")
    return keys.agg(F.count("*").alias("n_lines"), F.countDistinct("feature").alias("n_features"))


QUERIES: dict[str, Query] = {
    "ml_features": shown(ml_features, weather_code="double"),
    "ml_features_fanout": shown(ml_features_fanout, weather_code="double"),
    "ml_features_lags": shown(
        ml_features_lags,
        weather_code="double",
        is_raining="double",
        is_snowing="double",
        demand_lag_24h="double",
        demand_lag_168h="double",
    ),
    "mart_refresh": shown(mart_refresh, weather_code="double"),
    "table_counts": table_counts,
    "constraint_violations": constraint_violations,
    "generated_weather_flags": generated_weather_flags,
    "weather_code_names": weather_code_names,
    "weather_from_json": weather_from_json,
    "economic_from_json": shown(economic_from_json),
    "upsert_new_rows": upsert_new_rows,
    "upserted_table": upserted_table,
    "events_dedup": shown(events_dedup),
    "civic_events_csv": shown(civic_events_csv),
    "events_fallback": shown(events_fallback),
    "events_with_curated": shown(events_with_curated),
    "malformed_events": malformed_events,
    "appended_trips": appended_trips,
    "replaced_events": shown(replaced_events),
    "reloaded_events": shown(reloaded_events),
    "ordered_mart": ordered_mart,
    "recent_indicators": shown(recent_indicators),
    "clean_trips_loader": clean_trips(trips.clean_loader),
    "clean_trips_strict": clean_trips(trips.clean_strict),
    "month_file_counts": month_file_counts,
    "loaded_rows": loaded_rows,
    "amount_quality": amount_quality,
    "dropoff_fare_median": dropoff_fare_median,
    "residual_quantiles": residual_quantiles,
    "systematic_sample": systematic_sample,
    "random_sample": random_sample,
    "hourly_zone_demand": with_trips(analytics.hourly_zone_demand),
    "hourly_city_demand": with_trips(analytics.hourly_city_demand),
    "grand_totals": with_trips(analytics.grand_totals),
    "weather_impact": with_trips(analytics.weather_impact, "weather", scheme="impact", median_of="trip_distance"),
    "weather_impact_detail": with_trips(analytics.weather_impact, "weather", scheme="detail", median_of="fare_amount"),
    "weather_impact_basic": with_trips(analytics.weather_impact, "weather", scheme="basic", median_of="fare_amount"),
    "event_deviation": shown(with_trips(analytics.event_deviation, "civic_events")),
    "zone_leaderboard": with_trips(analytics.zone_leaderboard, "zones", limit=20),
    "dow_hour_heatmap": with_trips(analytics.dow_hour_heatmap),
    "heatmap_pivot": with_trips(analytics.heatmap_pivot),
    "event_before_after": shown(
        with_trips(analytics.event_before_after, "civic_events"), trips_day_before="double", trips_day_after="double"
    ),
    "event_before_after_calendar": shown(
        with_trips(analytics.event_before_after_calendar, "civic_events"),
        trips_day_before="double",
        trips_day_after="double",
    ),
    "monthly_revenue_mom": shown(with_months(analytics.monthly_revenue_mom)),
    "monthly_cumulative": shown(with_months(analytics.monthly_cumulative), prev_month_trips="double"),
    "zone_rain_share": with_trips(analytics.zone_rain_share, "weather", "zones", min_trips=MIN_ZONE_TRIPS),
    "precipitation_buckets": with_trips(analytics.precipitation_buckets, "weather"),
    "weekly_running_total": with_trips(analytics.weekly_running_total),
    "top_od_pairs": with_trips(analytics.top_od_pairs, "zones", min_trips=MIN_OD_TRIPS),
    "hour_context": with_trips(analytics.hour_context, "weather", "civic_events", "economics"),
    "hour_zone_context": with_trips(analytics.hour_zone_context, "zones", "weather", "civic_events", "economics"),
    "demand_by_hour": on_mart(analytics.demand_by_hour),
    "temperature_bins": on_mart(analytics.temperature_bins),
    "demand_by_weather": on_mart(analytics.demand_by_weather),
    "mart_health": on_mart(monitoring.mart_health),
    "data_range": on_mart(analytics.data_range),
    "zone_hourly_series": on_mart(analytics.zone_hourly_series, ZONE, START, END),
    "period_slice": on_mart(monitoring.period_slice, *CURRENT),
    "top_zone_filter": top_zone_filter,
    "zone_name_lookup": zone_name_lookup,
    "demand_lags": shown(on_counts(lags.row_lags), demand_lag_24h="double", demand_lag_168h="double"),
    "demand_lags_filled": on_counts(lags.row_lags_filled),
    "demand_lags_calendar": shown(
        on_counts(lags.calendar_lags), demand_lag_24h="double", demand_lag_168h="double"
    ),
    "rolling_7d": on_counts(lags.rolling_week),
    "fill_economic": shown(fill_economic),
    "features_train": features_train,
    "features_fit_apply": features_fit_apply,
    "features_serve": features_serve,
    "feature_nulls": feature_nulls,
    "validate_requests": validate_requests,
    "request_rows": request_rows,
    "request_rows_monday": request_rows_monday,
    "aligned_features": aligned_features,
    "safe_numbers": safe_numbers,
    "temporal_split": temporal_split,
    "fallback_split": fallback_split,
    "validation_tail": validation_tail,
    "historical_average": historical_average,
    "baseline_predictions": baseline_predictions,
    "regression_metrics": regression_metrics,
    "model_comparison": model_comparison,
    "best_model": best_model,
    "prediction_interval": prediction_interval,
    "interval_calibrated": interval_calibrated,
    "drift_numeric": drift_numeric,
    "drift_categorical": drift_categorical,
    "drift_summary": drift_summary,
    "random_forest": model_test_predictions("random_forest"),
    "random_forest_deep": model_test_predictions("random_forest_deep"),
    "boosted_a": model_test_predictions("boosted_a"),
    "boosted_b": model_test_predictions("boosted_b"),
    "linear_regression": model_test_predictions("linear"),
    "early_stopping": model_test_predictions("early_stopping"),
    "tuned_model": model_test_predictions("tuned"),
    "hyperparameter_search": hyperparameter_search,
    "run_log": run_log,
    "feature_importance": feature_importance,
    "forecast_vs_actual": forecast_vs_actual,
    "batch_scoring": batch_scoring,
    "tree_attributions": tree_attributions("boosted_a"),
    "forest_attributions": tree_attributions("random_forest"),
    "global_importance": global_importance,
    "dependence_data": dependence_data,
    "dependence_bins": dependence_bins,
    "local_waterfall": local_waterfall,
    **{
        f"{key}_rows": predicted_rows(name)
        for key, name in (
            ("random_forest", "random_forest"),
            ("random_forest_deep", "random_forest_deep"),
            ("boosted_a", "boosted_a"),
            ("boosted_b", "boosted_b"),
            ("linear_regression", "linear"),
            ("early_stopping", "early_stopping"),
            ("tuned_model", "tuned"),
        )
    },
    "stored_comparison": stored_comparison,
    "stored_comparison_facts": stored_comparison_facts,
    "search_facts": search_facts,
    "run_facts": run_facts,
    "importance_facts": importance_facts,
    "forecast_rows": forecast_rows,
    "scored_requests": scored_requests,
    "tree_attribution_gaps": attribution_gaps("boosted_a"),
    "forest_attribution_gaps": attribution_gaps("random_forest"),
    "dependence_values": dependence_values,
    "dependence_counts": dependence_counts,
    "waterfall_facts": waterfall_facts,
}
