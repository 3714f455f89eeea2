"""Batch scoring with intervals and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflow.functions.numbers import safe_float
from cityflow.operators.baseline import prediction_interval, served_trips
from cityflow.operators.boosting import Boosted
from cityflow.operators.forest import Forest
from cityflow.operators.tree_shap import Explainer, explain, explainer, model_nodes
from cityflow.plans.features import align_to, features_serve
from cityflow.plans.registry import MODEL_FEATURES
from cityflow.plans.requests import request_rows, validate_requests


def load_leaves(spark: SparkSession, model: Boosted | Forest, path: str) -> Explainer:
    """The leaves of a fitted ensemble, whose node table is saved once below `path`."""
    if isinstance(model, Boosted):
        model.nodes(spark).write.mode("overwrite").parquet(path)
        weights = dict.fromkeys(range(model.rounds), 1.0)
        return explainer(spark.read.parquet(path), len(MODEL_FEATURES), weights, model.base)
    # A forest averages its trees.
    model.nodes().write.mode("overwrite").parquet(path)
    each = 1.0 / model.settings.numTrees
    return explainer(model_nodes(spark, path), len(MODEL_FEATURES), dict.fromkeys(range(model.settings.numTrees), each))


def contribution_structs(values: Column) -> Column:
    """One struct per feature: name, input value, contribution."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(name).cast("double").alias("value"),
                values[i].alias("shap_value"),
            )
            for i, name in enumerate(MODEL_FEATURES)
        ]
    )


def top_factors(values: Column, n: int) -> Column:
    """The n strongest contributions of a row, strongest first, ready to be shown."""
    ranked = F.array_sort(
        F.transform(
            contribution_structs(values),
            lambda s: F.struct((-F.abs(s["shap_value"])).alias("k"), s["feature"].alias("feature"), s.alias("s")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, n),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            safe_float(r["s"]["value"]).alias("value"),
            safe_float(r["s"]["shap_value"]).alias("shap_value"),
            F.when(safe_float(r["s"]["shap_value"]) >= 0, "increases_demand")
            .otherwise("decreases_demand")
            .alias("direction"),
        ),
    )


def explained(matrix: DataFrame, model: Boosted | Forest, leaves: Explainer) -> DataFrame:
    """Raw predictions and one contribution per feature for rows of the feature matrix."""
    scored = model.transform(align_to(matrix, MODEL_FEATURES)).withColumnRenamed("prediction", "raw_prediction")
    return explain(scored.drop("features"), leaves, MODEL_FEATURES)


def score_requests(
    requests: DataFrame,
    zones: DataFrame,
    model: Boosted | Forest,
    leaves: Explainer,
    version: str,
    top_n: int = 5,
) -> DataFrame:
    """Predictions of the accepted requests; rejected ones are found by `validate_requests`."""
    accepted = validate_requests(requests).filter("accepted")
    matrix = features_serve(request_rows(accepted), keep=("request_id", "zone_id", "request_dt"))
    scored = explained(matrix, model, leaves)
    raw = F.col("raw_prediction")
    low, high = prediction_interval(raw)
    return scored.join(zones.select("zone_id", "zone_name"), "zone_id", "left").select(
        "request_id",
        "zone_id",
        "request_dt",
        served_trips(raw).cast("int").alias("predicted_trips"),
        F.array(low.cast("int"), high.cast("int")).alias("confidence_interval"),
        top_factors(F.col("contributions"), top_n).alias("top_factors"),
        F.lit(version).alias("model_version"),
        "zone_name",
    )


def global_importance(scored: DataFrame, top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, in one aggregation without exploding rows."""
    means = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.avg(F.abs(F.col("contributions")[i])).alias("mean_abs_shap"),
            )
            for i, name in enumerate(MODEL_FEATURES)
        ]
    )
    return (
        scored.agg(means.alias("r"))
        .select(F.inline("r"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
        .limit(top)
    )


def dependence_data(scored: DataFrame, feature: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(feature value, contribution) pairs."""
    i = MODEL_FEATURES.index(feature)
    return scored.select(
        *keep, F.col(feature).cast("double").alias("value"), F.col("contributions")[i].alias("shap_value")
    )


def dependence_bins(scored: DataFrame, feature: str, width: float) -> DataFrame:
    """Mean contribution per bin of the feature's value."""
    pairs = dependence_data(scored, feature)
    return (
        pairs.groupBy((F.floor(F.col("value") / width) * width).alias("bin"))
        .agg(F.count("*").alias("n"), F.round(F.avg("shap_value"), 6).alias("mean_shap"))
        .orderBy("bin")
    )


def local_waterfall(scored: DataFrame, top: int = 10) -> DataFrame:
    """Labelled contributions of single rows, largest first; `top` lines per row."""
    factors = F.slice(
        F.reverse(
            F.array_sort(
                F.transform(
                    contribution_structs(F.col("contributions")),
                    lambda s: F.struct(s["shap_value"].alias("shap"), s["feature"].alias("feature"), s["value"].alias("value")),
                )
            )
        ),
        1,
        top,
    )
    keys = [c for c in ("hour_bucket", "zone_id") if c in scored.columns]
    return scored.select(*keys, F.inline(factors)).withColumn(
        "label", F.format_string("%s = %.2f", "feature", "value")
    )
