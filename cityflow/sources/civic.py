"""Civic events: CSV lists, built-in lists, and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflow import schemas

# Built-in event list (fixed values): date, name, type, borough, attendance, major.
CURATED = (
    ("2024-01-01", "New Year's Day", "holiday", "Manhattan", 500000, True),
    ("2024-03-17", "St. Patrick's Day Parade", "parade", "Manhattan", 150000, True),
    ("2024-05-27", "Memorial Day", "holiday", "All", 0, False),
    ("2024-06-29", "NYC Pride Parade", "parade", "Manhattan", 100000, True),
    ("2024-07-04", "Independence Day", "holiday", "All", 500000, True),
    ("2024-11-04", "NYC Marathon", "sports", "All", 55000, True),
    ("2024-11-28", "Macy's Thanksgiving Parade", "parade", "Manhattan", 350000, True),
    ("2024-12-31", "New Year's Eve", "holiday", "Manhattan", 1000000, True),
)
ARENA = (
    ("2024-01-10", "Knicks vs Lakers", "sports", "Manhattan", 19500, False),
    ("2024-02-07", "Knicks vs Celtics", "sports", "Manhattan", 19500, False),
    ("2024-05-15", "Knicks Playoffs Game 1", "sports", "Manhattan", 19500, True),
)
KEY = ["event_date", "event_name"]
TYPES = {
    "event_date": "date",
    "event_name": "string",
    "event_type": "string",
    "borough": "string",
    "est_attendance": "int",
    "is_major": "boolean",
}


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The primary path, or the first fallback that exists on its file system."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(name: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(hadoop).exists(path)

    return next((p for p in paths if exists(p)), None)


def listed(spark: SparkSession, rows: tuple) -> DataFrame:
    typed = spark.createDataFrame(
        list(rows), schemas.EVENTS.replace("event_date DATE", "event_date STRING")
    )
    return typed.withColumn("event_date", F.to_date("event_date"))


def with_defaults(events: DataFrame) -> DataFrame:
    """Typed columns in table order; absent columns and nulls get their defaults."""
    out = events.select(
        *[
            (F.col(c).try_cast(t) if c in events.columns else F.lit(None).cast(t)).alias(c)
            for c, t in TYPES.items()
        ]
    )
    return out.fillna({"est_attendance": 0, "is_major": False})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event list from CSV; read as text and cast, so no inference pass is needed."""
    return with_defaults(spark.read.option("header", True).option("escape", '"').csv(path))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(field, value, n): what the file holds and ``read_csv`` can't read, so that no default hides it."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    fields = [
        F.when(F.col(c).try_cast(t).isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
        for c, t in TYPES.items()
        if c in raw.columns
    ]
    bad = raw.select(F.explode(F.array(*fields)).alias("x")).where("x.value is not null")
    return bad.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def combine(sources: list[DataFrame]) -> DataFrame:
    """Union in priority order; of repeats of a (date, name) the earliest source wins.

    The winner is the least struct of the group, which folds map-side instead of
    sorting the whole group in one task.
    """
    ranked = None
    for place, source in enumerate(sources):
        part = with_defaults(source).withColumn("_source", F.lit(place))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in TYPES if c not in KEY]
    winner = F.min(F.struct("_source", *rest)).alias("w")
    return ranked.groupBy(*KEY).agg(winner).select(*KEY, *[F.col(f"w.{c}").alias(c) for c in rest])


def build_events(spark: SparkSession, user_csv: str | None = None) -> DataFrame:
    """Built-in lists plus the user's list, in date order."""
    sources = [listed(spark, CURATED), listed(spark, ARENA)]
    if user_csv:
        sources.append(read_csv(spark, user_csv))
    return combine(sources).orderBy("event_date", "event_name")
