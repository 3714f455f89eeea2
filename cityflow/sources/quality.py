"""Row counts and constraint checks as jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflow.schemas import NOT_NULL, UNIQUE_KEY


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def table_listing(spark: SparkSession) -> DataFrame:
    """Names of the tables and views the session knows."""
    names = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "table_name STRING, table_type STRING").orderBy("table_name")


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Null values in required columns and surplus rows per unique key, one line per rule."""
    parts = []
    for name, df in tables.items():
        required = [c for c in NOT_NULL[name] if c in df.columns]
        nulls = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{c} is not null").alias("rule"),
                        F.count(F.when(F.col(c).isNull(), 1)).alias("violations"),
                    )
                    for c in required
                ]
            ).alias("r")
        )
        parts.append(
            nulls.select(F.lit(name).alias("table_name"), F.inline("r"))
        )
        key = list(UNIQUE_KEY[name])
        repeats = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(
            repeats.agg(
                F.lit(name).alias("table_name"),
                F.lit(f"unique ({', '.join(key)})").alias("rule"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"),
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "rule")
