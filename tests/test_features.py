from datetime import datetime, timedelta

import pytest
from martrows import mart_row
from pyspark.sql import functions as F

from cityflow.operators import fill, lags
from cityflow.plans import features
from cityflow.plans.registry import MODEL_FEATURES, feature_catalog

DRY = datetime(2024, 6, 15, 17)
RAINY = datetime(2024, 3, 10, 8)


def serve(make_mart, **changes):
    row = mart_row(changes.pop("hour", DRY), **changes)
    lag = {"demand_lag_24h": F.lit(260.0), "demand_lag_168h": F.lit(270.0)}
    return features.features_serve(make_mart([row]).withColumns(lag)).first()


def test_shape_and_order(make_mart):
    rows = [mart_row(DRY + timedelta(hours=i), trip_count=100 + i) for i in range(30)]
    matrix = features.features_train(make_mart(rows))
    assert tuple(matrix.columns) == ("hour_bucket", "zone_id", "trip_count", *MODEL_FEATURES)
    assert len(MODEL_FEATURES) == 24 and matrix.count() == 30
    assert all(r.n_null == 0 for r in features.feature_nulls(matrix).collect())


def test_cycles_are_bounded(make_mart):
    r = serve(make_mart)
    assert all(-1 <= r[c] <= 1 for c in MODEL_FEATURES if c.endswith(("_sin", "_cos")))


@pytest.mark.parametrize(
    "hour,rush", [(datetime(2024, 3, 11, 8), 1), (datetime(2024, 3, 10, 8), 0), (datetime(2024, 3, 11, 12), 0)]
)
def test_rush_hour(make_mart, hour, rush):
    assert serve(make_mart, hour=hour).is_rush_hour == rush


@pytest.mark.parametrize(
    "flags,severity",
    [
        (dict(), 0),
        (dict(windspeed_mph=25.0), 1),
        (dict(is_raining=1), 2),
        (dict(is_raining=1, windspeed_mph=25.0), 3),
        (dict(is_snowing=1, is_raining=1, windspeed_mph=25.0), 3),
    ],
)
def test_severity(make_mart, flags, severity):
    assert serve(make_mart, **flags).weather_severity == severity


def test_serve_constants(make_mart):
    row = mart_row(DRY, precipitation_mm=None, unemployment_rate=None, is_raining=None)
    lag = {"demand_lag_24h": F.lit(0.0), "demand_lag_168h": F.lit(None).cast("double")}
    r = features.features_serve(make_mart([row]).withColumns(lag)).first()
    assert (r.precipitation_mm, r.unemployment_rate, r.is_raining) == (60.0, 0.0, 0)
    assert (r.demand_lag_24h, r.demand_lag_168h, r.demand_rolling_7d_avg) == (200.0, 200.0, 200.0)


def test_many_served_rows_equal_single_ones(make_mart):
    rows = [mart_row(DRY, temperature_f=None), mart_row(RAINY, temperature_f=10.0)]
    zero = {"demand_lag_24h": F.lit(0.0), "demand_lag_168h": F.lit(0.0)}
    both = features.features_serve(make_mart(rows).withColumns(zero)).collect()
    single = [features.features_serve(make_mart([r]).withColumns(zero)).first() for r in rows]
    assert sorted(map(tuple, both)) == sorted(map(tuple, single))


def test_train_fills(make_mart):
    rows = [
        mart_row(DRY + timedelta(hours=i), trip_count=10 * (i + 1), temperature_f=None if i == 3 else float(i))
        for i in range(26)
    ]
    got = features.features_train(make_mart(rows)).orderBy("hour_bucket").collect()
    present = [float(i) for i in range(26) if i != 3]
    assert got[3].temperature_f == sorted(present)[12]
    assert got[0].demand_lag_24h == 10 and got[24].demand_lag_24h == 10 and got[25].demand_lag_24h == 20
    assert got[3].demand_lag_168h == (10 + 20 + 30 + 40) / 4
    assert got[3].demand_rolling_7d_avg == 25.0


def test_absent_indicators_become_zero(make_mart):
    rows = [mart_row(DRY + timedelta(hours=i)) for i in range(3)]
    bare = make_mart(rows).drop("unemployment_rate", "gas_price_avg")
    got = features.features_train(bare).collect()
    assert {(r.unemployment_rate, r.gas_price_avg, r.consumer_sentiment) for r in got} == {(0.0, 0.0, 76.0)}


def test_past_only_keeps_the_target_out(make_mart):
    rows = [mart_row(DRY + timedelta(hours=i), trip_count=10 * (i + 1)) for i in range(5)]
    got = features.features_train(make_mart(rows), past_only=True).orderBy("hour_bucket").collect()
    assert [r.demand_rolling_7d_avg for r in got] == [30.0, 10.0, 15.0, 20.0, 25.0]


def test_row_and_calendar_lags_differ_over_a_gap(make_mart):
    hours = [DRY + timedelta(hours=i) for i in range(30) if i != 10]
    mart = make_mart([mart_row(h, trip_count=i) for i, h in enumerate(hours)]).select(
        "hour_bucket", "zone_id", "trip_count"
    )
    last = hours[-1]
    by_row = lags.row_lags(mart).filter(F.col("hour_bucket") == F.lit(last)).first()
    by_clock = lags.calendar_lags(mart).filter(F.col("hour_bucket") == F.lit(last)).first()
    assert by_row.demand_lag_24h == len(hours) - 1 - 24
    assert by_clock.demand_lag_24h == hours.index(last - timedelta(hours=24))
    gap = lags.calendar_lags(mart).filter(F.col("hour_bucket") == F.lit(hours[0] + timedelta(hours=24))).first()
    assert gap.demand_lag_24h == 0 and gap.demand_lag_168h is None


def test_month_fill(spark):
    months = spark.createDataFrame(
        [("2024-01-01", None, None), ("2024-02-01", 2.0, None), ("2024-03-01", None, None)],
        "m STRING, a DOUBLE, b DOUBLE",
    ).select(F.to_date("m").alias("month_start"), "a", "b")
    rows = fill.fill_months(months, ("a", "b")).orderBy("month_start").collect()
    assert [(r.a, r.b) for r in rows] == [(2.0, 0.0)] * 3


def test_catalogue_is_read_off_the_matrix(make_mart):
    matrix = features.features_train(make_mart([mart_row(DRY + timedelta(hours=i), trip_count=i) for i in range(30)]))
    rows = {r.feature: r for r in feature_catalog(matrix).collect()}
    assert sorted(rows, key=lambda f: rows[f].place) == list(MODEL_FEATURES)
    assert rows["is_rush_hour"].is_flag and not rows["temperature_f"].is_flag
    assert rows["temperature_f"].low == rows["temperature_f"].high == 78.5 and all(r.n_null == 0 for r in rows.values())


def test_fills_come_from_the_training_part(make_mart):
    """Test demand and test weather may change as they like: training rows stay as they are."""
    START = DRY.replace(day=29, hour=8)  # the test part begins with July

    def matrix(factor):
        rows = [
            mart_row(START + timedelta(hours=i), trip_count=(i + 1) * (factor if i >= 40 else 1),
                     temperature_f=None if i % 3 else 50.0 + i * (factor if i >= 40 else 1),
                     gas_price_avg=None if i < 40 else 3.0 * factor)
            for i in range(60)
        ]
        mart = make_mart(rows)
        late = F.col("hour_bucket") >= F.lit(START + timedelta(hours=40))
        found = features.features_train(mart, fitted_on=mart.where(~late), past_only=True)
        return [tuple(r) for r in found.where(~late).orderBy("hour_bucket").collect()]

    assert matrix(1) == matrix(100)


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0)], "id INT, b DOUBLE")
    assert tuple(features.align_to(df, ("a", "b")).first()) == (1, 0.0, 2.0)
