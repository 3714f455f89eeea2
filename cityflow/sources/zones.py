"""Known zones (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names shown with predictions; every other zone has none.
ZONE_NAMES = {
    107: "Gramercy",
    132: "JFK Airport",
    138: "LaGuardia Airport",
    142: "Lincoln Square E",
    161: "Midtown Center",
    162: "Midtown East",
    163: "Midtown North",
    170: "Murray Hill",
    186: "Penn Station / MSG",
    230: "Times Sq / Theatre District",
    234: "Union Square",
    236: "UES North",
    237: "UES South",
}
# The most active zones, for models that concentrate on them.
TOP_ZONES = (161, 162, 230, 186, 237, 48, 163, 164, 100, 234)


def named_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ZONE_NAMES.items()), "zone_id INT, zone_name STRING")


def top_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(z,) for z in TOP_ZONES], "zone_id INT")
