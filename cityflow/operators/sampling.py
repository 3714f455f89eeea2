"""Deterministic samples."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.operators.ordered import with_position

#: Bits of a row's place in its partition in Spark's increasing ids.
_PLACE = 33


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n, first, last, rising) of a partition: how many rows it has, its ends, and whether keys rise from row to row."""
    part, n, first, last, rising = None, 0, None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rising &= batch.column(1).null_count == 0
        keys = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        rising &= bool((np.diff(keys) > 0).all()) and (last is None or bool(last < keys[0]))
        part, n, last = batch.column(0)[0].as_py(), n + len(keys), int(keys[-1])
        first = int(keys[0]) if first is None else first
    if n:
        columns = [pa.array([v], k) for v, k in ((part, pa.int64()), (n, pa.int64()), (first, pa.int64()), (last, pa.int64()), (rising, pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n", "first", "last", "rising"])


def placed_as_read(rows: DataFrame, key: str, name: str) -> DataFrame | None:
    """The rows with their position by a unique integer key, if they are read in its order; None if they are not.

    One pass over the key counts each partition's rows and looks whether keys rise; the driver gets one line a partition.
    Where partitions follow each other too, a row's position is its place in the partition plus the rows of the
    partitions before, so no row is moved. That asks for rows that come from files by filters and expressions only.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return None
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keys = rows.select(F.spark_partition_id().cast("long").alias("part"), F.col(key).cast("long").alias("key"))
    found = keys.mapInArrow(_stretches, "part long, n long, first long, last long, rising boolean").collect()
    found.sort(key=lambda r: r.first)
    if not all(r.rising for r in found) or any(a.last >= b.first for a, b in zip(found, found[1:])):
        return None
    starts, before = [], 0
    for r in found:
        starts.append((r.part, before))
        before += r.n
    table = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", _PLACE), F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    joined = marked.join(F.broadcast(table), part == F.col("_part"))  # a line for each partition
    return joined.withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every n-th row in the order of a unique integer key, starting with the first; null keys come first.

    Rows that are read in this order stay where they are; others are placed by value ranges.
    """
    placed = placed_as_read(rows, key, "_position")
    if placed is None:
        placed = with_position(rows, [key], "_position")
    return placed.filter(F.col("_position") % n == 0).drop("_position")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn uniformly by a seeded hash of the key: the same rows on every run."""
    ticket = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.withColumn("_ticket", ticket).orderBy("_ticket", key).limit(n).drop("_ticket")
