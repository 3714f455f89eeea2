import itertools
import math
import threading
from datetime import datetime, timedelta
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from martrows import mart_row
from pyspark.sql import functions as F

from cityflow import catalog
from cityflow.operators import baseline, drift, metrics, split, tree_shap
from cityflow.plans import features, requests, scoring, training
from cityflow.plans.registry import MODEL_FEATURES
from cityflow.sources.zones import named_zones


def measured(spark, actual, predicted):
    rows = spark.createDataFrame(list(zip(map(float, actual), map(float, predicted))), "actual DOUBLE, prediction DOUBLE")
    return metrics.regression_metrics(rows).first()


def test_perfect(spark):
    m = measured(spark, [100, 200, 300], [100, 200, 300])
    assert (m.rmse, m.mae, m.mape, m.r2) == (0, 0, 0, 1)


def test_rmse_is_at_least_mae(spark):
    m = measured(spark, [100, 200, 300, 400], [120, 180, 350, 390])
    assert m.rmse >= m.mae
    assert m.rmse == pytest.approx(math.sqrt((400 + 400 + 2500 + 100) / 4), abs=1e-6)


def test_mape_skips_zeros(spark):
    assert measured(spark, [0, 100, 200], [10, 110, 190]).mape == pytest.approx(7.5)
    assert math.isnan(measured(spark, [0, 0], [1, 2]).mape)


def test_bad_fit_has_negative_r2(spark):
    assert measured(spark, [10, 20, 30, 40], [40, 30, 20, 10]).r2 < 0


def test_comparison_is_sorted(spark):
    rows = spark.createDataFrame(
        [("bad", 1.0, 9.0), ("good", 1.0, 1.5), ("bad", 2.0, 0.0), ("good", 2.0, 2.0)],
        "model STRING, actual DOUBLE, prediction DOUBLE",
    )
    table = metrics.model_comparison(rows)
    assert [r.model for r in table.collect()] == ["good", "bad"]
    assert metrics.best_model(rows).first().model == "good"
    assert metrics.best_model(rows, excluded=("good",)).first().model == "bad"


@pytest.fixture(scope="module")
def synthetic(spark, make_mart):
    """Four months of hourly rows over four zones, fixed seed and fixed end."""
    rng = np.random.default_rng(42)
    rows = []
    for i in range(24 * 120):
        h = datetime(2024, 1, 1) + timedelta(hours=i)
        rows.append(
            mart_row(
                h,
                zone_id=int(rng.integers(1, 5)),
                trip_count=int(20 + 10 * h.hour + rng.integers(0, 30)),
                temperature_f=float(rng.uniform(30, 90)),
                windspeed_mph=float(rng.uniform(0, 30)),
                is_raining=int(rng.integers(0, 2)),
            )
        )
    return make_mart(rows).persist()


def test_split_has_no_leak(synthetic):
    parts = split.temporal_split(synthetic, 2)
    bounds = (F.min("hour_bucket").alias("lo"), F.max("hour_bucket").alias("hi"), F.count("*").alias("n"))
    b = {r.split: r for r in parts.groupBy("split").agg(*bounds).collect()}
    assert b["train"].hi < b["test"].lo
    assert b["train"].n + b["test"].n == synthetic.count()
    assert 0.4 < b["test"].n / synthetic.count() < 0.6


def test_tails_are_positional(spark, synthetic):
    tail = split.validation_tail(synthetic.select("hour_bucket", "zone_id", "trip_count"), 0.1)
    counts = {r.split: r["count"] for r in tail.groupBy("split").count().collect()}
    assert counts == {"fit": 2592, "validation": 288}
    last_fit = tail.filter("split = 'fit'").agg(F.max("hour_bucket")).first()[0]
    assert tail.filter("split = 'validation'").agg(F.min("hour_bucket")).first()[0] > last_fit


def test_positional_split_is_a_choice_and_keeps_null_hours(make_mart):
    rows = [mart_row(datetime(2024, 1, 1) + timedelta(hours=i // 2), zone_id=i % 2) for i in range(49)]
    mart = make_mart([*rows, {**rows[0], "hour_bucket": None}])
    parts = split.fallback_split(mart)
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 40, "test": 10}
    assert parts.where("hour_bucket is null").first().split == "train"
    assert split.fallback_split(mart.where("false")).count() == 0


def test_splits_do_not_shuffle_the_mart(make_mart):
    mart = make_mart([mart_row(datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(50)])
    plan = split.validation_tail(mart)._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("scalar-subquery")[0]
    assert "Join" not in main and "Window" not in main


def test_baseline_falls_back_to_the_mean(make_mart):
    monday = datetime(2024, 1, 1, 5)
    train = make_mart([mart_row(monday, trip_count=10), mart_row(monday + timedelta(days=7), trip_count=20)])
    test = make_mart([mart_row(monday + timedelta(days=14)), mart_row(monday, zone_id=7)])
    got = {r.zone_id: r.prediction for r in baseline.baseline_predictions(train, test).collect()}
    assert got == {161: 15.0, 7: 15.0}


def test_interval(spark):
    low, high = baseline.prediction_interval(F.col("p"))
    df = spark.createDataFrame([(100.0,), (-50.0,), (2.5,)], "p DOUBLE")
    rows = df.select(low.alias("lo"), high.alias("hi"), baseline.served_trips(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(80, 119, 100), (0, 0, 0), (2, 2, 2)]


@pytest.fixture(scope="module")
def matrix(synthetic):
    return features.features_train(synthetic, past_only=True).persist()


@pytest.fixture(scope="module")
def trained(spark, matrix):
    parts = split.temporal_split(matrix, 1)
    train = split.validation_tail(parts.filter("split = 'train'").drop("split"))
    test = parts.filter("split = 'test'").drop("split")
    return training.train_all(train, test, ("linear", "random_forest", "boosted_a"), "small", early_stop="boosted_a"), test


def test_training_end_to_end(spark, trained, tmp_path):
    runs, test = trained
    assert {r.model for r in runs} == {"linear", "random_forest", "boosted_a"}
    best = training.best_run(runs, excluded=("linear",))
    assert best.metrics["r2"] > 0.5
    log = training.run_log(spark, runs).collect()
    assert all(r.rmse >= r.mae > 0 and r.train_s >= 0 for r in log)
    training.save_artifact(spark, str(tmp_path / "a"), best, runs)
    model, meta = training.load_artifact(spark, str(tmp_path / "a"))
    assert meta["model"] == best.model and tuple(meta["inputs"]) == MODEL_FEATURES and meta["scores"]["rmse"] > 0
    again = [r.prediction for r in training.predictions(model, test).select("prediction").limit(5).collect()]
    assert again == [r.prediction for r in training.predictions(best.fitted, test).select("prediction").limit(5).collect()]
    assert min(again) >= 0


def test_fits_run_side_by_side(monkeypatch):
    """Each fit waits here until others are under way; the runs come in the order of the run table."""
    meeting = threading.Barrier(2)

    def timed(spark, sf, name):
        meeting.wait(20)
        return name, 0.0

    monkeypatch.setattr(catalog, "_once", lambda spark, sf, name, build: build())
    monkeypatch.setattr(catalog, "_stored", lambda spark, sf: (None, None))
    monkeypatch.setattr(catalog, "_timed", timed)
    for module, name in ((catalog, "day_mart"), (split, "temporal_split")):
        monkeypatch.setattr(module, name, MagicMock())
    monkeypatch.setattr(training, "baseline_run", lambda *parts: "historical_average")
    monkeypatch.setattr(training, "measured", lambda name, *rest: name)
    assert catalog._runs(None, "") == ["historical_average", *catalog.RUNS]


def test_a_repeated_append_adds_nothing(spark, trained, tmp_path):
    runs, _ = trained
    path = str(tmp_path / "runs")
    for some, run_id in ((runs[:1], "first"), (runs[1:], "second"), (runs[1:], "second"), (runs[:1], "third")):
        training.append_runs(spark, some, path, run_id)
    rows = [(r.run_id, r.model) for r in training.read_runs(spark, path).collect()]
    assert sorted(rows) == sorted([("first", runs[0].model), ("third", runs[0].model), *[("second", r.model) for r in runs[1:]]])


def test_candidates_are_seeded_and_in_range():
    drawn = training.candidates(20)
    assert drawn == training.candidates(20) and len(drawn) == 20
    assert all(200 <= c["rounds"] <= 1000 and 0.01 <= c["rate"] <= 0.3 and 1e-8 <= c["alpha"] <= 10 for c in drawn)


def brute_force(nodes: pd.DataFrame, weight: dict, x: np.ndarray, n: int) -> np.ndarray:
    """Shapley values by enumerating every subset of the features a tree uses."""

    def value(tree, node, known):
        r = tree.loc[node]
        if r.leftChild < 0:
            return r.prediction
        if int(r.feature) in known:
            return value(tree, r.leftChild if x[int(r.feature)] <= r.threshold else r.rightChild, known)
        left, right = tree.loc[r.leftChild], tree.loc[r.rightChild]
        return (
            left.cover * value(tree, r.leftChild, known) + right.cover * value(tree, r.rightChild, known)
        ) / r.cover

    phi = np.zeros(n)
    for t, frame in nodes.groupby("treeID"):
        tree = frame.set_index("id")
        used = sorted({int(f) for f, c in zip(tree.feature, tree.leftChild) if c >= 0})
        for j in used:
            others = [f for f in used if f != j]
            for size in range(len(others) + 1):
                share = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
                for subset in itertools.combinations(others, size):
                    gain = value(tree, 0, {*subset, j}) - value(tree, 0, set(subset))
                    phi[j] += weight[t] * share * gain
    return phi


def all_attributions(leaves, x):
    return sum(tree_shap.attributions(piece, x) for piece in leaves.pieces())


@pytest.mark.parametrize("name", ["random_forest", "boosted_a"])
def test_attributions_add_up(spark, trained, tmp_path, name):
    runs, test = trained
    model = next(r.fitted for r in runs if r.model == name)
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "nodes"))
    rows = scoring.explained(test.orderBy("hour_bucket").limit(40), model, leaves).collect()
    for r in rows:
        assert sum(r.contributions) + r.base_value == pytest.approx(r.raw_prediction, rel=1e-9)


@pytest.mark.parametrize("name,small", [("random_forest", {"numTrees": 3, "maxDepth": 3}), ("boosted_a", {"rounds": 3, "depth": 3})])
def test_attributions_equal_brute_force(spark, matrix, tmp_path, name, small):
    model = training.fit(name, matrix, "small", **small)
    path = str(tmp_path / "nodes")
    leaves = scoring.load_leaves(spark, model, path)
    forest = name == "random_forest"
    nodes = (tree_shap.model_nodes(spark, path) if forest else spark.read.parquet(path)).toPandas()
    weight = dict.fromkeys(range(3), 1 / 3 if forest else 1.0)
    for r in matrix.limit(5).collect():
        x = np.array([float(r[c]) for c in MODEL_FEATURES])
        want = brute_force(nodes, weight, x, 24)
        assert all_attributions(leaves, x[None, :])[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("depth", [3, 9])
def test_digits_do_not_depend_on_batches_or_pieces(spark, trained, tmp_path, monkeypatch, depth):
    runs, test = trained
    train = test.withColumn("trip_count", F.col("trip_count") + F.rand(1) * 5)
    model = training.fit("random_forest", train, "small", maxDepth=depth, numTrees=4)
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "nodes"))
    x = np.random.default_rng(0).normal(size=(300, len(MODEL_FEATURES))) * 20
    whole = all_attributions(leaves, x)
    assert (np.concatenate([all_attributions(leaves, x[i : i + 1]) for i in range(300)]) == whole).all()
    monkeypatch.setattr(tree_shap, "CELLS_PER_BLOCK", 20)
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "nodes"))
    assert len(leaves.blocks) > 1 and all_attributions(leaves, x) == pytest.approx(whole, abs=1e-9)
    rows = scoring.explained(test.limit(50), model, leaves).select("contributions", "base_value", "raw_prediction").collect()
    assert all(sum(r.contributions) + r.base_value == pytest.approx(r.raw_prediction, abs=1e-6) for r in rows)


def test_a_deep_forest_is_explained(spark, matrix, tmp_path):
    model = training.fit("random_forest_deep", matrix, "full", numTrees=20)
    assert max(t.depth for t in model.stages[-1].trees) > 8
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "nodes"))
    rows = scoring.explained(matrix.limit(30), model, leaves).collect()
    assert all(sum(r.contributions) + r.base_value == pytest.approx(r.raw_prediction, rel=1e-9) for r in rows)
    leaves.release()


def test_reports_on_attributions(spark, trained, tmp_path):
    runs, test = trained
    model = next(r.fitted for r in runs if r.model == "boosted_a")
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "n"))
    scored = scoring.explained(test.limit(50), model, leaves).persist()
    top = scoring.global_importance(scored).collect()
    assert len(top) == 15 and [r.mean_abs_shap for r in top] == sorted((r.mean_abs_shap for r in top), reverse=True)
    assert top[0].feature in ("hour_sin", "hour_cos", "demand_lag_24h")
    lines = scoring.local_waterfall(scored.limit(1)).collect()
    assert len(lines) == 10 and " = " in lines[0].label
    assert sum(r.n for r in scoring.dependence_bins(scored, "temperature_f", 5.0).collect()) == 50
    assert training.feature_importance(spark, model).count() == 15


REQUEST = dict(
    request_id=1, zone_id=161, request_dt=datetime(2024, 6, 15, 18, 34, 22), temperature_f=78.5, feels_like_f=80.0,
    precipitation_mm=0.0, windspeed_mph=8.2, humidity_pct=65.0, weather_code=1, has_major_event=False, event_attendance=0,
)
REQUEST_SCHEMA = (
    "request_id INT, zone_id INT, request_dt TIMESTAMP_NTZ, temperature_f DOUBLE, feels_like_f DOUBLE, "
    "precipitation_mm DOUBLE, windspeed_mph DOUBLE, humidity_pct DOUBLE, weather_code INT, has_major_event BOOLEAN, "
    "event_attendance INT"
)


@pytest.mark.parametrize(
    "change,errors",
    [
        ({}, []),
        ({"zone_id": -1}, ["zone_id"]),
        ({"zone_id": 999}, ["zone_id"]),
        ({"temperature_f": 9999.0}, ["temperature_f"]),
        ({"precipitation_mm": -5.0}, ["precipitation_mm"]),
        ({"zone_id": None, "request_dt": None}, ["request_dt", "zone_id"]),
        ({"humidity_pct": None, "weather_code": None}, []),
        ({"zone_id": 263, "temperature_f": -40.0}, []),
    ],
)
def test_validation(spark, change, errors):
    r = requests.validate_requests(spark.createDataFrame([{**REQUEST, **change}], REQUEST_SCHEMA)).first()
    assert list(r.errors) == errors and r.accepted == (not errors)


def test_missing_columns_take_defaults(spark):
    bare = spark.createDataFrame([REQUEST], REQUEST_SCHEMA).drop("humidity_pct", "weather_code", "has_major_event")
    r = requests.validate_requests(bare).first()
    assert (r.humidity_pct, r.weather_code, r.has_major_event, r.accepted) == (50.0, 0, False, True)
    assert r.request_dt == datetime(2024, 6, 15, 18)


def test_weekday_conventions(spark):
    accepted = requests.validate_requests(spark.createDataFrame([REQUEST], REQUEST_SCHEMA))
    saturday = (requests.request_rows(accepted), requests.request_rows(accepted, monday_first=True))
    assert [r.first().day_of_week for r in saturday] == [6, 5]
    assert [r.first().is_weekend for r in saturday] == [1, 1]


def test_scoring(spark, trained, tmp_path):
    runs, _ = trained
    model = next(r.fitted for r in runs if r.model == "boosted_a")
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "n"))
    zones = named_zones(spark)
    asked = spark.createDataFrame(
        [REQUEST, {**REQUEST, "request_id": 2, "zone_id": 99}, {**REQUEST, "request_id": 3, "zone_id": 0}], REQUEST_SCHEMA
    )
    rows = {r.request_id: r for r in scoring.score_requests(asked, zones, model, leaves, "1.0.0").collect()}
    assert set(rows) == {1, 2}
    assert rows[1].zone_name == "Midtown Center" and rows[2].zone_name is None
    for r in rows.values():
        low, high = r.confidence_interval
        assert 0 <= low <= high and r.predicted_trips >= 0 and len(r.top_factors) == 5
        sizes = [abs(f.shap_value) for f in r.top_factors]
        assert sizes == sorted(sizes, reverse=True)
        assert all((f.shap_value >= 0) == (f.direction == "increases_demand") for f in r.top_factors)


def test_no_drift_against_itself(synthetic):
    copy = synthetic.select("trip_count", "temperature_f", "zone_id")
    both = copy.withColumn("period", F.lit("reference")).unionByName(copy.withColumn("period", F.lit("current")))
    rows = drift.drift_numeric(both, ("trip_count", "temperature_f")).collect()
    assert all((r.ks, r.wasserstein, r.psi, r.drifted) == (0, 0, 0, False) for r in rows)
    assert drift.drift_categorical(both, "zone_id").first().jensen_shannon == 0


def test_shift_is_found(spark):
    rows = [("reference", float(i)) for i in range(200)] + [("current", float(i + 50)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "period STRING, x DOUBLE").withColumn("zone_id", F.col("x") % 3)
    r = drift.drift_numeric(labelled, ("x",)).first()
    assert r.ks == pytest.approx(0.25) and r.wasserstein == pytest.approx(50.0) and r.drifted
    s = drift.drift_summary(labelled, ("x",), "zone_id").first()
    assert (s.n_features, s.n_drifted, s.dataset_drift) == (2, 1, True)
