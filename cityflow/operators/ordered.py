"""Order statistics without putting a whole group into one task.

Values are first folded to (key, value, count), which collapses repeats
map-side. The folded rows are cut into value ranges: one aggregate counts them
by a coarse logarithmic bin, and every bin is then divided evenly into as many
ranges as its share of the rows asks for. Running counts are the sum over the
ranges before (a frame of a few thousand rows per key at most) plus a window inside one
range; a quantile only looks into the ranges that hold it. Null keys are keys
like any other, and every size takes the same path. The folded rows are read
three times, so callers write them first (``store.settle``); what they come from
is then read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges that all bins together are divided into, besides one for each bin; bins for each factor of e.
RANGES, PER_E = 4096, 8
#: Above the number of any bin of a finite value, and above the ranges of any bin.
_BINS, _DIVISIONS = 1 << 14, 1 << 16


def _bin(value: Column) -> Column:
    """A number that never falls as the value rises; -1 for null, NaN is the greatest."""
    size = F.floor(F.log(F.abs(value)) * PER_E) + _BINS // 2
    signed = F.when(value > 0, size).when(value < 0, -size).otherwise(0)
    infinite = F.abs(value) == float("inf")
    beyond = F.when(F.isnan(value), _BINS + 1).when(infinite, F.signum(value) * _BINS).otherwise(signed)
    return F.when(value.isNull(), -1).otherwise(beyond.cast("long") + _BINS + 1).cast("long")


def with_range(rows: DataFrame, value: str) -> DataFrame:
    """Add `_range`, a number that never falls as the value rises, with few rows to each number; -1 for a null value."""
    at = F.col(value).cast("double")
    binned = rows.withColumn("_bin", _bin(at))
    sizes = binned.groupBy(F.col("_bin").alias("_in")).agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    whole = W.partitionBy()  # a row for each bin
    share = F.ceil(F.col("_n") * RANGES / F.sum("_n").over(whole))
    sizes = sizes.select("_in", "_lo", (F.col("_hi") - F.col("_lo")).alias("_width"), share.cast("long").alias("_parts"))
    joined = binned.join(sizes, F.col("_bin") == F.col("_in"))
    inside = F.least(F.floor((at - F.col("_lo")) / F.col("_width") * F.col("_parts")), F.col("_parts") - 1)
    part = F.when((F.col("_parts") > 1) & (F.col("_width") > 0) & (F.col("_width") < float("inf")), inside).otherwise(0)
    number = F.when(F.col("_bin") < 0, -1).otherwise(F.col("_bin") * _DIVISIONS + part)
    return joined.withColumn("_range", number.cast("long")).drop("_bin", "_in", "_lo", "_width", "_parts")


def _same(keys: list[str], at: str = "_at") -> Column:
    """Rows of equal keys and range, null keys included."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col(at))


def running_counts(folded: DataFrame, keys: list[str], value: str, counts: list[str]) -> DataFrame:
    """Add `<count>_upto` (inclusive running sum), `<count>_total` and `next_value` per key.

    `folded` holds one row per (keys, value), without null values; keys may be null.
    """
    ranged = with_range(folded, value)
    by_range = ranged.groupBy(*keys, "_range").agg(
        F.min(value).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in counts]
    )
    ordered = W.partitionBy(*keys).orderBy("_range")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = by_range.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_range").alias("_at"),
        F.lead("_first").over(ordered).alias("_next_first"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_before") for c in counts],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in counts],
    )
    inside = W.partitionBy(*keys, "_range").orderBy(value)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.join(offsets, _same(keys)).select(
        *keys,
        value,
        *counts,
        *[(F.col(f"_{c}_before") + F.sum(c).over(so_far)).alias(f"{c}_upto") for c in counts],
        *[f"{c}_total" for c in counts],
        F.coalesce(F.lead(value).over(inside), F.col("_next_first")).alias("next_value"),
    )


def exact_quantiles(
    folded: DataFrame, keys: list[str], value: str, count: str, quantiles: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles (PERCENTILE_CONT) per key from rows unique in (keys, value)."""
    ranged = with_range(folded.select(*keys, value, F.col(count).alias("_n")), value)
    ordered = W.partitionBy(*keys).orderBy("_range")
    by_range = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in_range"))
    upto, total = F.sum("_in_range").over(ordered), F.sum("_in_range").over(W.partitionBy(*keys))
    ranges = by_range.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at"),
        (upto - F.col("_in_range")).alias("_before"), (upto - 1).alias("_last"), total.alias("_n_total"),
    )
    place = {name: (F.col("_n_total") - 1).cast("double") * p for name, p in quantiles.items()}
    sides = [(name, side, index) for name in quantiles for side, index in (("lo", F.floor(place[name])), ("hi", F.ceil(place[name])))]
    hit = ranges.where(reduce(Column.__or__, [i.between(F.col("_before"), F.col("_last")) for _, _, i in sides]))
    inside = W.partitionBy(*keys, "_range").orderBy(value)
    last = F.col("_before") + F.sum("_n").over(inside) - 1
    placed = ranged.join(hit, _same(keys)).select(*keys, value, "_n_total", (last - F.col("_n") + 1).alias("_f"), last.alias("_l"))
    found = [F.max(F.when(i.between(F.col("_f"), F.col("_l")), F.col(value))).alias(f"_{name}_{side}") for name, side, i in sides]
    out = placed.groupBy(*keys).agg(F.max("_n_total").alias("_n_total"), *found)

    def between(name: str) -> Column:
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (place[name] - F.floor(place[name]))).alias(name)

    return out.select(*keys, *[between(name) for name in quantiles])


def with_position(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Zero-based position in the order of some columns, of which the first is a number; nulls come first.

    The first column is cut into value ranges, so only rows of one range meet in a task.
    """
    blocked = with_range(rows, order[0])
    sizes = blocked.groupBy("_range").agg(F.count("*").alias("_size"))  # one row for each range
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("_range").orderBy(*order)
    return (
        blocked.join(starts, F.col("_range") == F.col("_at"))
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_range", "_at", "_start")
    )
