"""Distribution drift between a reference and a current period.

All statistics come from value counts per feature. Numeric ones need running
counts, which are taken range by range (see ``ordered``), so neither a constant
nor a high-cardinality feature lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflow.operators.ordered import exact_quantiles, running_counts
from cityflow.sources.store import settle

PERIODS = ("reference", "current")
BINS = 10
EPSILON = 1e-4


def label_periods(mart: DataFrame, reference: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """Keep the rows of the two half-open periods and name them."""
    h = F.col("hour_bucket")
    inside = [
        (h >= F.lit(a).cast("timestamp_ntz")) & (h < F.lit(b).cast("timestamp_ntz"))
        for a, b in (reference, current)
    ]
    return mart.filter(inside[0] | inside[1]).withColumn(
        "period", F.when(inside[0], PERIODS[0]).otherwise(PERIODS[1])
    )


def numeric_values(labelled: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(feature, value, reference, current) counts; nulls take the period's median."""
    long = labelled.select(
        "period",
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
            )
        ).alias("x"),
    )
    counts = settle(long.groupBy("period", "x.feature", "x.value").agg(F.count("*").alias("n")), "drift-counts")
    known = counts.filter(F.col("value").isNotNull())
    medians = exact_quantiles(known, ["period", "feature"], "value", "n", {"median": 0.5})
    filled = (
        counts.filter(F.col("value").isNull())
        .join(medians, ["period", "feature"], "left")
        .select("period", "feature", F.col("median").alias("value"), "n")
        .filter(F.col("value").isNotNull())
    )
    in_period = lambda p: F.sum(F.when(F.col("period") == p, F.col("n")).otherwise(0))
    return (
        known.unionByName(filled)
        .groupBy("feature", "value")
        .agg(in_period("reference").alias("reference"), in_period("current").alias("current"))
    )


def _psi(p: Column, q: Column) -> Column:
    p, q = F.greatest(p, F.lit(EPSILON)), F.greatest(q, F.lit(EPSILON))
    return (q - p) * F.log(q / p)


def drift_numeric(labelled: DataFrame, features: tuple[str, ...], threshold: float = 0.1) -> DataFrame:
    """Kolmogorov-Smirnov distance, Wasserstein distance, and PSI on reference deciles."""
    values = settle(numeric_values(labelled, features), "drift-values")
    ran = running_counts(values, ["feature"], "value", ["reference", "current"])
    share = lambda c: F.try_divide(F.col(c), F.col(f"{c[:-5]}_total"))
    gap = F.abs(share("reference_upto") - share("current_upto"))
    before = F.col("reference_upto") - F.col("reference")
    decile = F.least(
        F.lit(BINS - 1), F.floor(F.try_divide(before * BINS, F.col("reference_total"))).cast("int")
    )
    per_bin = ran.groupBy("feature", decile.alias("bin")).agg(
        F.max(gap).alias("ks"),
        F.sum(gap * (F.coalesce("next_value", "value") - F.col("value"))).alias("wasserstein"),
        F.sum("reference").alias("r"),
        F.sum("current").alias("c"),
        F.max("reference_total").alias("rt"),
        F.max("current_total").alias("ct"),
    )
    psi = _psi(F.try_divide(F.col("r"), F.col("rt")), F.try_divide(F.col("c"), F.col("ct")))
    return per_bin.groupBy("feature").agg(
        F.round(F.max("ks"), 6).alias("ks"),
        F.round(F.sum("wasserstein"), 6).alias("wasserstein"),
        F.round(F.sum(psi), 6).alias("psi"),
        (F.max("ks") > threshold).alias("drifted"),
    )


def drift_categorical(labelled: DataFrame, feature: str, threshold: float = 0.1) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) between the category shares."""
    counts = labelled.groupBy(F.col(feature).alias("category")).agg(
        F.count(F.when(F.col("period") == "reference", 1)).alias("r"),
        F.count(F.when(F.col("period") == "current", 1)).alias("c"),
    )
    # Totals come from a second, one-row aggregate of the counts.
    totals = counts.agg(F.struct(F.sum("r").alias("r"), F.sum("c").alias("c")).alias("t")).scalar()
    parts = counts.withColumn("t", totals).select(
        F.try_divide(F.col("r"), F.col("t.r")).alias("p"), F.try_divide(F.col("c"), F.col("t.c")).alias("q")
    )
    mid = (F.col("p") + F.col("q")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.sum(half("p") + half("q")) / 2))
    return parts.agg(
        F.lit(feature).alias("feature"),
        F.round(distance, 6).alias("jensen_shannon"),
        (distance > threshold).alias("drifted"),
    )


def drift_summary(
    labelled: DataFrame,
    numeric: tuple[str, ...],
    categorical: str,
    threshold: float = 0.1,
    dataset_share: float = 0.5,
) -> DataFrame:
    flags = (
        drift_numeric(labelled, numeric, threshold)
        .select("feature", "drifted")
        .unionByName(drift_categorical(labelled, categorical, threshold).select("feature", "drifted"))
    )
    drifted = F.sum(F.col("drifted").cast("int"))
    return flags.agg(
        F.count("*").alias("n_features"),
        drifted.alias("n_drifted"),
        F.round(drifted / F.count("*"), 6).alias("drift_share"),
        (drifted / F.count("*") >= dataset_share).alias("dataset_drift"),
    )
