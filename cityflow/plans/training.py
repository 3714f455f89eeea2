"""Model training, tuning, comparison and artifacts."""

from __future__ import annotations

import math
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cityflow.operators import forest, metrics
from cityflow.operators.baseline import baseline_predictions
from cityflow.operators.boosting import Binned, Boosted, Settings, binned, boost
from cityflow.operators.forest import Forest, fit_forest
from cityflow.plans.registry import MODEL_FEATURES

SEED = 42
VERSION = "1.0.0"

# Session setting that picks the preset of the registered model keys.
PRESET_SETTING = "cityflow.models.preset"

# Model settings (fixed values): the published ones, and a small set for quick runs.
PRESETS = {
    "full": {
        "random_forest": dict(numTrees=300, maxDepth=12, minInstancesPerNode=5),
        "random_forest_deep": dict(numTrees=300, maxDepth=14, minInstancesPerNode=3),
        "boosted_a": dict(rounds=600, depth=7, rate=0.05, rows=0.8, columns=0.8, penalty=1.0),
        "boosted_b": dict(rounds=500, depth=8, rate=0.05, rows=0.8, columns=0.8, leaves=63, least=20),
    },
    "small": {
        "random_forest": dict(numTrees=10, maxDepth=5, minInstancesPerNode=5),
        "random_forest_deep": dict(numTrees=10, maxDepth=6, minInstancesPerNode=3),
        "boosted_a": dict(rounds=8, depth=4, rate=0.2, rows=0.8, columns=0.8, penalty=1.0),
        "boosted_b": dict(rounds=8, depth=5, rate=0.2, rows=0.8, columns=0.8, leaves=20, least=20),
    },
}
# Trials of the search, and rounds without a better validation error after which boosting stops (fixed values).
TRIALS = 50
PATIENCE = 30


def preset_of(spark: SparkSession) -> str:
    """The preset that the session asks for: full are the published settings, the default."""
    return spark.conf.get(PRESET_SETTING, "full")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="features")


def pipeline(**overrides) -> Pipeline:
    """The linear model of the library on scaled features and `trip_count`."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    linear = LinearRegression(**{"featuresCol": "scaled", "labelCol": "trip_count", "predictionCol": "prediction", **overrides})
    return Pipeline(stages=[assembler(), scaler, linear])


def is_boosted(name: str) -> bool:
    return name.startswith("boosted") or name in ("early_stopping", "tuned")


def is_forest(name: str) -> bool:
    return name.startswith("random_forest")


def settings(name: str, preset: str = "full", **overrides) -> Settings:
    return Settings(**{"seed": SEED, **PRESETS[preset][name], **overrides})


def fit(name: str, train: DataFrame, preset: str = "full", **overrides) -> PipelineModel | Boosted | Forest:
    """A model fitted on all the rows."""
    if name == "linear":
        return pipeline(**overrides).fit(train)
    data = binned(train, MODEL_FEATURES, "trip_count", **({"bins": forest.MAX_BINS} if is_forest(name) else {}))
    try:
        if is_forest(name):
            return fit_forest(data, forest.Settings(**{"seed": SEED, **PRESETS[preset][name], **overrides}))
        return boost(data, settings(name, preset, **overrides))
    finally:
        data.unpersist()


def with_validation(labelled: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> Binned:
    """The `fit` and `validation` rows of a table with a `split`, binned; edges come from the fit rows."""
    rows = labelled.filter(F.col("split").isin("fit", "validation"))
    return binned(rows, features, "trip_count", F.col("split") == "validation")


def fit_early_stopping(
    labelled: DataFrame, name: str = "boosted_a", preset: str = "full", patience: int = PATIENCE, **overrides
) -> Boosted:
    """Boosting on the `fit` part of `split` until patience on the `validation` part runs out."""
    data = with_validation(labelled)
    try:
        return boost(data, settings(name, preset, patience=patience, **overrides))
    finally:
        data.unpersist()


def predictions(model: PipelineModel | Boosted | Forest, rows: DataFrame) -> DataFrame:
    """Non-negative predictions next to the input columns."""
    scored = model.transform(rows)
    return scored.withColumn("prediction", F.greatest(F.lit(0.0), "prediction")).withColumn(
        "actual", F.col("trip_count")
    )


# ---- hyper-parameter search -------------------------------------------------

# name -> (low, high, scale); the search space (fixed values).
SPACE = {
    "rounds": (200, 1000, "int"),
    "depth": (3, 10, "int"),
    "rate": (0.01, 0.3, "log"),
    "rows": (0.6, 1.0, "linear"),
    "columns": (0.6, 1.0, "linear"),
    "least": (1, 10, "int"),
    "alpha": (1e-8, 10.0, "log"),
    "penalty": (1e-8, 10.0, "log"),
}


def candidates(trials: int, space: dict = SPACE, seed: int = SEED) -> list[dict]:
    """Seeded random settings drawn from the search space."""
    rng = random.Random(seed)

    def draw(low, high, scale):
        if scale == "int":
            return rng.randint(low, high)
        return math.exp(rng.uniform(math.log(low), math.log(high))) if scale == "log" else rng.uniform(low, high)

    return [{k: draw(*limits) for k, limits in space.items()} for _ in range(trials)]


@dataclass(frozen=True)
class Trial:
    """Drawn settings, their error on the validation part, the rounds that were kept and those that were run."""

    rmse: float
    drawn: dict
    kept: int
    run: int


def tune(
    labelled: DataFrame,
    trials: int = TRIALS,
    space: dict = SPACE,
    patience: int = PATIENCE,
    parallel: int = 8,
    features: tuple[str, ...] = MODEL_FEATURES,
) -> tuple[list[Trial], Boosted]:
    """All trials, best first, and the best one's model.

    The rows are binned and cached once. Each trial boosts until patience on the temporal validation part runs out,
    never on shuffled folds; a few trials run side by side, as their jobs leave cores free on small tables.
    """
    data, lock = with_validation(labelled, features), threading.Lock()
    best: list[tuple[float, int, Boosted]] = []

    def trial(number: int, drawn: dict) -> tuple[int, Trial]:
        model = boost(data, Settings(**drawn, seed=SEED, patience=patience))
        done = Trial(min(model.errors), drawn, model.rounds, len(model.errors))
        with lock:  # only the best model is kept
            best.append((done.rmse, number, model))
            best.sort(key=lambda b: b[:2])
            del best[1:]
        return number, done

    try:
        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(trial, range(trials), candidates(trials, space)))
    finally:
        data.unpersist()
    return [t for _, t in sorted(done, key=lambda d: (d[1].rmse, d[0]))], best[0][2]


# ---- runs -------------------------------------------------------------------


@dataclass
class Run:
    model: str
    params: dict
    metrics: dict
    seconds: float
    fitted: PipelineModel | Boosted | Forest | None = field(repr=False)


def measured(name: str, model: PipelineModel | Boosted | Forest, seconds: float, test: DataFrame) -> Run:
    """A fitted model as a run: its settings, its errors on the test part, and how long the fit took."""
    if isinstance(model, Boosted | Forest):
        params = model.params
    else:
        params = {p.name: v for p, v in model.stages[-1].extractParamMap().items()}
    return Run(name, params, metrics.regression_metrics(predictions(model, test)).first().asDict(), round(seconds, 1), model)


def train_all(
    train: DataFrame, test: DataFrame, names: tuple[str, ...], preset: str = "full", early_stop: str | None = None
) -> list[Run]:
    """Fit every model, time it and measure it on the test part.

    ``train`` carries a `split` column (fit / validation); only the model named
    by ``early_stop`` sees the validation rows while fitting.
    """
    train = train.persist()
    test = test.persist()
    runs = []
    try:
        for name in names:
            started = time.monotonic()
            if name == early_stop:
                model = fit_early_stopping(train, name, preset)
            else:
                model = fit(name, train.filter(F.col("split") == "fit"), preset)
            runs.append(measured(name, model, time.monotonic() - started, test))
    finally:
        train.unpersist()
        test.unpersist()
    return runs


def run_log(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """One row per run: settings, metrics and fitting time."""
    return spark.createDataFrame(
        [
            (
                r.model,
                {k: str(v) for k, v in r.params.items()},
                *[float(r.metrics[m]) for m in metrics.METRICS],
                float(r.seconds),
            )
            for r in runs
        ],
        "model STRING, params MAP<STRING, STRING>, rmse DOUBLE, mae DOUBLE, mape DOUBLE, r2 DOUBLE, train_s DOUBLE",
    )


def append_runs(spark: SparkSession, runs: list[Run], path: str, run_id: str) -> None:
    """Add the runs to the table at the path, below a folder of the run id: a repeated append replaces its own rows."""
    rows = run_log(spark, runs).withColumn("run_id", F.lit(run_id)).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the table, with the run id they were appended under."""
    kinds = run_log(spark, []).schema.add("run_id", "string")
    return spark.read.schema(kinds).parquet(path)


def store_predictions(rows: DataFrame, path: str, model: str, run_id: str) -> None:
    """Keep a run's predictions (keys, actual, prediction) below a folder of the model and run; a retry replaces them."""
    named = rows.withColumns({"model": F.lit(model), "run_id": F.lit(run_id)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run_id").parquet(path)


def baseline_run(train: DataFrame, test: DataFrame) -> Run:
    """The historical average as a run of its own, timed like the models."""
    started = time.monotonic()
    measured = metrics.regression_metrics(baseline_predictions(train, test)).first().asDict()
    return Run("historical_average", {}, measured, round(time.monotonic() - started, 1), None)


def best_run(runs: list[Run], excluded: tuple[str, ...] = ()) -> Run:
    return min((r for r in runs if r.model not in excluded), key=lambda r: r.metrics["rmse"])


# ---- artifacts --------------------------------------------------------------

ARTIFACT = "model STRING, version STRING, inputs ARRAY<STRING>, scores MAP<STRING, DOUBLE>"


def save_artifact(spark: SparkSession, path: str, best: Run, runs: list[Run]) -> None:
    """The fitted pipeline, a one-row table that describes it, and the runs it was chosen from."""
    if isinstance(best.fitted, Boosted):
        best.fitted.save(spark, f"{path}/model")
    elif isinstance(best.fitted, Forest):
        best.fitted.save(f"{path}/model")
    else:
        best.fitted.write().overwrite().save(f"{path}/model")
    scores = {k: float(v) for k, v in best.metrics.items()}
    row = spark.createDataFrame([(best.model, VERSION, list(MODEL_FEATURES), scores)], ARTIFACT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    run_log(spark, runs).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel | Boosted | Forest, Row]:
    """The fitted model and its description."""
    about = spark.read.parquet(f"{path}/about").first()
    if is_boosted(about.model) or is_forest(about.model):
        return (Boosted if is_boosted(about.model) else Forest).load(spark, f"{path}/model"), about
    return PipelineModel.load(f"{path}/model"), about


def feature_importance(spark: SparkSession, model: PipelineModel | Boosted | Forest, top: int = 15) -> DataFrame:
    values = model.importance if isinstance(model, Boosted | Forest) else model.stages[-1].featureImportances.toArray()
    return (
        spark.createDataFrame(
            [(n, float(v)) for n, v in zip(MODEL_FEATURES, values)], "feature STRING, importance DOUBLE"
        )
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
