"""Trip files: scan, rename, clean."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from cityflow.functions.numbers import clip

# Vendor name -> table name (fixed values).
COLUMN_MAP = {
    "tpep_pickup_datetime": "pickup_dt",
    "tpep_dropoff_datetime": "dropoff_dt",
    "PULocationID": "pickup_zone",
    "DOLocationID": "dropoff_zone",
    "passenger_count": "passenger_cnt",
    "trip_distance": "trip_distance",
    "fare_amount": "fare_amount",
    "total_amount": "total_amount",
    "payment_type": "payment_type",
}
TYPES = {
    "pickup_dt": "timestamp_ntz",
    "dropoff_dt": "timestamp_ntz",
    "pickup_zone": "bigint",
    "dropoff_zone": "bigint",
    "passenger_cnt": "bigint",
    "trip_distance": "double",
    "fare_amount": "double",
    "total_amount": "double",
    "payment_type": "bigint",
}
# File name pattern and valid ranges (fixed values).
FILE_NAME = "yellow_tripdata_{month}.parquet"
VALID_ZONES = (1, 263)
VALID_FARE = (0, 500)
VALID_DISTANCE = (0, 100)
#: Footers that a task reads.
PATHS_PER_TASK = 256


def month_paths(folder: str, months: tuple[str, ...]) -> list[str]:
    return [f"{folder.rstrip('/')}/{FILE_NAME.format(month=m)}" for m in months]


def _footer(path: str) -> str | None:
    """The Spark schema (JSON) in the footer of a Parquet file, or of the first file of a folder; nothing where the
    file system is none that Arrow can open."""
    try:
        store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)
        if store.get_file_info(name).type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(name, recursive=True))
            files = sorted(f.path for f in inside if f.is_file and not f.base_name.startswith(("_", ".")))
            name = files[0]
        return from_arrow_schema(pq.read_schema(name, filesystem=store), prefer_timestamp_ntz=True).json()
    except (pa.ArrowException, OSError, IndexError, ValueError):
        return None


def footer_schemas(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The schema of each path as JSON. Tasks read the footers, hundreds of paths each; only a path whose file system they
    can't open is asked through the session, one by one."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_footer(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "schema"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(-(-len(paths) // PATHS_PER_TASK))
    found = {r.path: r.schema for r in listed.mapInArrow(read, "path string, schema string").collect()}
    return {p: found[p] or spark.read.parquet(p).schema.json() for p in paths}


def scan_months(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Monthly files, mapped columns only, with the name of the file each row came from.

    Vendor files change numeric types between months. Files of one footer schema share a scan,
    which is cast before the union, so the plan grows with the number of schemas and not of files.
    """
    by_schema: dict[str, list[str]] = {}
    for path, schema in footer_schemas(spark, paths).items():
        by_schema.setdefault(schema, []).append(path)

    def scan(schema: str, group: list[str]) -> DataFrame:
        raw = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*group)
        kept = [c for c in COLUMN_MAP if c in raw.columns]
        file = F.regexp_extract("_metadata.file_path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1)
        return raw.select(
            *[F.col(c).cast(TYPES[COLUMN_MAP[c]]).alias(COLUMN_MAP[c]) for c in kept], file.alias("source_file")
        )

    scans = [scan(schema, group) for schema, group in by_schema.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def rename_known(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rename the mapped columns and keep those that exist, plus `extra`."""
    named = raw.withColumnsRenamed(COLUMN_MAP)
    keep = (*extra, *COLUMN_MAP.values())
    return named.select(*[c for c in keep if c in named.columns])


def _fill(trips: DataFrame) -> DataFrame:
    defaults = {"dropoff_zone": 0, "passenger_cnt": 1, "payment_type": 0}
    return trips.fillna({c: v for c, v in defaults.items() if c in trips.columns})


def clean_loader(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Bulk-load rule: complete pickups, positive fare and distance."""
    trips = rename_known(raw, extra).dropna(subset=["pickup_dt", "dropoff_dt", "pickup_zone"])
    return _fill(trips.filter((F.col("fare_amount") > 0) & (F.col("trip_distance") > 0)))


def in_valid_ranges() -> Column:
    return F.col("fare_amount").between(*VALID_FARE) & F.col("trip_distance").between(*VALID_DISTANCE)


def clean_strict(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Strict rule: known zone, fare and distance in range (bounds included), narrow types."""
    trips = rename_known(raw, extra).filter(
        F.col("pickup_dt").isNotNull()
        & F.col("dropoff_dt").isNotNull()
        & F.col("pickup_zone").between(*VALID_ZONES)
        & in_valid_ranges()
    )
    trips = _fill(trips)
    casts = {
        "pickup_zone": F.col("pickup_zone").cast("smallint"),
        "dropoff_zone": F.col("dropoff_zone").cast("smallint"),
        "passenger_cnt": clip(F.col("passenger_cnt"), 0, 9).cast("tinyint"),
        "payment_type": F.col("payment_type").cast("tinyint"),
    }
    return trips.withColumns({c: e for c, e in casts.items() if c in trips.columns})


def clean_for_sample(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rule of the sampled load: complete pickups, fare and distance in range, any zone."""
    trips = rename_known(raw, extra).dropna(subset=["pickup_dt", "dropoff_dt", "pickup_zone"])
    trips = _fill(trips.filter(in_valid_ranges()))
    return trips.withColumn("passenger_cnt", clip(F.col("passenger_cnt"), 0, 9).cast("int"))


def rows_per_file(trips: DataFrame) -> DataFrame:
    return trips.groupBy("source_file").agg(F.count("*").alias("rows")).orderBy("source_file")
