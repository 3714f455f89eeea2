"""What several operators share: reading, stored intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cityflow
from cityflow.session import scratch


#: By application: the folder from which the driver hands out the package while it runs.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


#: Rows of an Arrow batch at most. Rows hold whole texts, and a task keeps several batches in and outside the JVM.
ARROW_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Hand this package's files to the executors' Python workers, once for each application, and keep the
    session's Arrow batches small."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ARROW_ROWS:
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(cityflow.__file__).parent
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory()
    path = f"{folder.name}/cityflow-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text) of a table of documents, whatever else it carries."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken = {c.lower() for c in docs.columns}
    longest = max(map(len, taken), default=0)
    return [n if n.lower() not in taken else n + "_" * (longest + 1) for n in names]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the folder all executors share and go on from the files.

    This cuts lineage: a lost executor costs no more than its running tasks.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``settle`` wrote, once nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getName().startswith("cityflow-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Shuffle partitions for so many rows, never below the session's own setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an edge list (a, b) of longs: rows (node, component), the smallest node.

    Alternating large and small stars: each round every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows. Both steps are an aggregate with map-side
    combine and a join that adaptive execution can split, so the neighbours of a hub are never
    gathered in one task. Rounds are written to the shared folder. Self loops are dropped;
    an empty list gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, seen = settle(pairs, name), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(least.select("u", F.col("m").alias("v")).union(small).distinct(), name)
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    hubs = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        hubs.select("node", F.col("node").alias("component"))
    )
