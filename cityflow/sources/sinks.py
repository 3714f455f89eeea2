"""Writers and refreshes of Parquet tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityflow.sources.civic import first_existing


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def reload(rows: DataFrame, path: str, identity: str, order: list[str]) -> None:
    """Empty the table and load it again; rows are numbered from 1 in the given order.

    For tables of the size of a dimension: one task numbers all rows.
    """
    numbered = rows.withColumn(identity, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    replace(numbered.select(identity, *rows.columns), path)


def read_from(spark: SparkSession, path: str, column: str, first: str) -> DataFrame:
    """Rows of a stored table from a value of a column on; the bound has the column's type and reaches the scan."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(column) >= F.lit(first).cast(rows.schema[column].dataType))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A stored mart in the order of hours and zones."""
    return read_mart(spark, path).orderBy("hour_bucket", "zone_id")


def distinct_keys(new: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the least of several, folded map-side."""
    rest = [c for c in new.columns if c not in key]
    if not rest:
        return new.distinct()
    picked = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in new.columns])


def absent_rows(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `existing`, one per key."""
    return distinct_keys(new, key).join(existing.select(*key), key, "left_anti").select(*new.columns)


#: Folder column of a table kept by calendar units of its first key column.
KEY_UNIT = "key_unit"


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(KEY_UNIT)


def stored_near(new: DataFrame, path: str, key: list[str], unit: str | None = None) -> DataFrame:
    """The stored rows that can share a key with `new`: those between the bounds of its first key column, which come
    from one small aggregate. Row groups outside are passed over by their statistics, and folders outside are not listed
    as input if the table is kept by calendar units."""
    stored = new.sparkSession.read.parquet(path)
    low, high = new.agg(F.min(key[0]), F.max(key[0])).first()
    kind = stored.schema[key[0]].dataType
    near = stored.filter(F.col(key[0]).between(F.lit(low).cast(kind), F.lit(high).cast(kind)) | F.col(key[0]).isNull())
    if unit:
        first, last = (F.to_date(F.date_trunc(unit, F.lit(v).cast(kind))) for v in (low, high))
        near = near.filter(F.col(KEY_UNIT).between(first, last) | F.col(KEY_UNIT).isNull())
    return near


def upsert_new_rows(new: DataFrame, path: str, key: list[str], unit: str | None = None) -> None:
    """Append the rows whose key is not stored yet; stored rows never change.

    With ``unit`` the table is kept in one folder for each calendar unit of the first key column, a timestamp, and
    only folders that the new rows can touch are read. A table that is not there yet is made.
    """
    spark = new.sparkSession
    if first_existing(spark, [path]):
        new = absent_rows(new, stored_near(new, path, key, unit), key)
    else:
        new = distinct_keys(new, key)
    if unit:
        dated = new.withColumn(KEY_UNIT, F.to_date(F.date_trunc(unit, key[0])))
        dated.write.mode("append").partitionBy(KEY_UNIT).parquet(path)
    else:
        append(new, path)


def write_mart(mart: DataFrame, path: str, unit: str = "MM", mode: str = "static") -> None:
    """Mart table with one folder per calendar unit, rows ordered by zone for row-group skipping.

    Rows of a unit are brought together; adaptive execution splits a unit that
    is larger than its target size. ``mode="dynamic"`` replaces only the units
    that occur in `mart` and leaves all others untouched.
    """
    _write_units(mart.withColumn("mart_unit", F.to_date(F.date_trunc(unit, "hour_bucket"))), path, mode)


def _write_units(dated: DataFrame, path: str, mode: str) -> None:
    (
        dated.hint("rebalance", F.col("mart_unit"))
        .sortWithinPartitions("mart_unit", "zone_id", "hour_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("mart_unit")
        .parquet(path)
    )


def refresh_mart(mart: DataFrame, path: str, unit: str = "MM", units: list[date] | None = None) -> None:
    """Replace the touched calendar units of a stored mart: those with rows in `mart`, and those listed.

    A listed unit without any row left is replaced by one empty row, which ``read_mart`` passes over.
    """
    if units:
        listed = mart.sparkSession.createDataFrame([(u,) for u in units], "mart_unit DATE")
        there = mart.select(F.to_date(F.date_trunc(unit, "hour_bucket")).alias("mart_unit")).distinct()
        emptied = listed.join(there, "mart_unit", "left_anti").select(
            *[F.lit(None).cast(t).alias(c) for c, t in mart.dtypes], "mart_unit"
        )
        dated = mart.withColumn("mart_unit", F.to_date(F.date_trunc(unit, "hour_bucket"))).unionByName(emptied)
        _write_units(dated, path, "dynamic")
    else:
        write_mart(mart, path, unit, "dynamic")


def read_mart(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, unit: str = "MM"
) -> DataFrame:
    """Read [start, end) of a stored mart; the bounds prune folders."""
    mart = spark.read.parquet(path).where("hour_bucket is not null")
    h, u = F.col("hour_bucket"), F.col("mart_unit")
    if start:
        first = F.lit(start).cast("timestamp_ntz")
        mart = mart.filter((h >= first) & (u >= F.to_date(F.date_trunc(unit, first))))
    if end:
        last = F.lit(end).cast("timestamp_ntz")
        mart = mart.filter((h < last) & (u <= F.to_date(last)))
    return mart.drop("mart_unit")
