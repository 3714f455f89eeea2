"""Tables kept in the cluster's shared folder.

A frame that several branches of a job read is written once and read back: the
lineage is cut, a lost executor costs a re-read instead of a recomputation, and
the planner knows the table's size when it picks a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cityflow.session import scratch

_tables: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def settle(rows: DataFrame, name: str = "settled") -> DataFrame:
    """Write the frame to a fresh table and return its scan."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def stored(
    spark: SparkSession,
    source: str,
    name: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """The table `name` derived from `source`, built once per application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _tables:
        path = scratch(spark, name)
        rows = build()
        if write:
            write(rows, path)
        else:
            rows.write.parquet(path)
        _tables[key] = (path, spark.read.parquet(path).schema)
    path, schema = _tables[key]
    return spark.read.schema(schema).parquet(path)
