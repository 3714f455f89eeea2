"""Exact per-row attributions of MLlib tree ensembles.

For one leaf with value v whose path tests the features j = 1..d, let o_j say
whether the row passes every test on feature j, and z_j be the share of
training rows that do (product of child/parent covers). With the path-dependent
value function, the Shapley value of feature j is

    v * (o_j - z_j) * integral_0^1 prod_{i != j} (z_i (1 - t) + o_i t) dt

because the Shapley weight |S|! (d - 1 - |S|)! / d! is the integral of
t^|S| (1 - t)^(d - 1 - |S|). The integrand has degree d - 1, so Gauss-Legendre
with ceil(d / 2) nodes is exact. Paths are built by joins over the node table, level by
level, and packed into blocks of leaves. The one block of a small model is broadcast, and rows
stay in their partitions. The blocks of a larger model stay a table: chunks of rows meet them in tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.operators.crossed import crossed
from cityflow.session import remove, scratch

CELLS_PER_BLOCK = 100_000  # leaves x path length of one block; 32 bytes each
CELLS_PER_LEAF_BLOCK = 500  # leaves x path length worked on at once: what they look up stays in the processor's cache
CELLS_PER_CHUNK = 200_000
LOOKUP_DEPTH = 8
LEVELS_PER_TABLE = 4  # joins between two written tables of paths


@dataclass(frozen=True)
class Leaves:
    """All leaves of an ensemble; path tests merged per feature and padded to equal length."""

    feature: np.ndarray  # (leaves, d) int
    low: np.ndarray  # (leaves, d): passes when low < x <= high
    high: np.ndarray
    cover: np.ndarray  # (leaves, d) z_j, 1.0 where padded
    value: np.ndarray  # (leaves,) weighted leaf value
    n_features: int


@dataclass
class Explainer:
    """The leaves of an ensemble in blocks, and the expected prediction when no feature is known.

    A single block is broadcast; of several, ``blocks`` holds the numbers, and ``table`` the blocks.
    """

    blocks: list
    n_features: int
    base: float
    depth: int = 1
    table: DataFrame | None = None
    files: tuple[str, ...] = ()

    def pieces(self) -> Iterator[Leaves]:
        if self.table is None:
            found = (block.value for block in self.blocks)
        else:
            found = (_shaped(r, self.depth) for r in self.table.toLocalIterator())
        for block in found:
            yield Leaves(*block, self.n_features)

    def release(self) -> None:
        if self.table is None:
            for block in self.blocks:
                block.destroy()
        else:
            for file in self.files:
                remove(self.table.sparkSession, file)


def _shaped(row: tuple, depth: int) -> tuple:
    """The arrays of a block from a row of the packed table, whose first column numbers it."""
    cells = [np.frombuffer(row[i], np.int64 if i == 1 else float).reshape(-1, depth) for i in range(1, 5)]
    return (*cells, np.frombuffer(row[5]))


def leaf_paths(nodes: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(treeID, id, value, tests) of every leaf: its weighted value, and one test (feature, low, high, cover) for each
    feature on its path, passed when low < x <= high.

    One join of nodes and their children, and then one join for each level, which lengthens all
    open paths by their next test. Every few levels the paths are written.
    """
    spark, files = nodes.sparkSession, []

    def kept(rows: DataFrame) -> DataFrame:
        files.append(scratch(spark, "leaf-paths"))
        rows.write.parquet(files[-1])
        return spark.read.parquet(files[-1])

    share = spark.createDataFrame([(int(t), float(w)) for t, w in weights.items()], "treeID int, weight double")
    value = (F.col("prediction") * F.col("weight")).alias("value")
    every = nodes.join(share, "treeID").select("treeID", "id", "leftChild", "rightChild", "feature", "threshold", "cover", value)
    inner = F.col("leftChild") >= 0
    side = lambda child, low, high: F.struct(
        F.col(child).alias("child"), low.cast("double").alias("low"), high.cast("double").alias("high")
    )
    sides = F.array(
        side("leftChild", F.lit("-Infinity"), F.col("threshold")), side("rightChild", F.col("threshold"), F.lit("Infinity"))
    )
    below = every.where(inner).select("treeID", F.col("id").alias("parent"), "feature", F.col("cover").alias("whole"), F.explode(sides).alias("s"))
    child = every.select("treeID", F.col("id").alias("s_child"), "value", "cover", inner.alias("is_inner"))
    below = below.withColumn("s_child", F.col("s.child")).join(child, ["treeID", "s_child"])
    test = F.struct("feature", F.col("s.low").alias("low"), F.col("s.high").alias("high"), (F.col("cover") / F.col("whole")).alias("cover"))
    below = kept(below.select("treeID", "parent", "s_child", "is_inner", F.col("value").alias("v"), test.alias("test")))
    none = F.slice(F.array(F.struct(F.lit(0).alias("feature"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(1.0).alias("cover"))), 1, 0)
    paths = every.where("id = 0").select("treeID", "id", "value", inner.alias("is_open"), none.alias("tests"))
    while True:
        for _ in range(LEVELS_PER_TABLE):
            at = (paths["treeID"] == below["treeID"]) & (paths["id"] == below["parent"])
            further = F.when(F.col("test").isNull(), F.col("tests")).otherwise(F.concat("tests", F.array("test")))
            paths = paths.join(below, at, "left").select(
                paths["treeID"], F.coalesce("s_child", "id").alias("id"), F.coalesce("v", "value").alias("value"),
                F.coalesce("is_inner", F.lit(False)).alias("is_open"), further.alias("tests"),
            )
        paths = kept(paths)
        if paths.where("is_open").isEmpty():
            break
        remove(spark, files.pop(-2)) if len(files) > 2 else None
    of = lambda f: F.filter("tests", lambda t: t["feature"] == f)
    merged = F.transform(
        F.array_distinct(F.transform("tests", lambda t: t["feature"])),
        lambda f: F.struct(
            f.alias("feature"),
            F.array_max(F.transform(of(f), lambda t: t["low"])).alias("low"),
            F.array_min(F.transform(of(f), lambda t: t["high"])).alias("high"),
            F.aggregate(of(f), F.lit(1.0), lambda z, t: z * t["cover"]).alias("cover"),
        ),
    )
    return paths.select("treeID", "id", "value", merged.alias("tests"))


def _packed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Leaves as arrays of equal path length, so many to a row that it has a bounded size."""
    for batch in batches:
        step = max(1, CELLS_PER_BLOCK // depth)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            tests, n = part.column("tests"), part.num_rows
            sizes = tests.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat, out = tests.flatten(), []
            for name, fill, kind in (("feature", 0, np.int64), ("low", -np.inf, float), ("high", np.inf, float), ("cover", 1.0, float)):
                cells = np.full((n, depth), fill, kind)
                cells[row, place] = flat.field(name).to_numpy(zero_copy_only=False)
                out.append(pa.array([cells.tobytes()], pa.binary()))
            out.append(pa.array([part.column("value").to_numpy().tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["feature", "low", "high", "cover", "value"])


def explainer(nodes: DataFrame, n_features: int, weights: dict[int, float], offset: float = 0.0) -> Explainer:
    """Blocks of leaves of an ensemble of any size; only one that is a single block passes through the driver."""
    spark = nodes.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path, blocks = scratch(spark, "leaves"), scratch(spark, "leaf-blocks")
    leaf_paths(nodes, weights).write.parquet(path)
    leaves = spark.read.parquet(path)
    expected = F.col("value") * F.aggregate("tests", F.lit(1.0), lambda z, t: z * t["cover"])
    base, depth, n = leaves.agg(F.sum(expected), F.max(F.size("tests")), F.count("*")).first()
    depth, base = max(1, depth or 0), (base or 0.0) + offset
    rows = leaves.select("tests", "value")
    if (n or 0) * depth <= CELLS_PER_BLOCK:
        rows = rows.coalesce(1)
    packed = rows.mapInArrow(
        lambda it: _packed(it, depth), "feature binary, low binary, high binary, cover binary, value binary"
    )
    packed.select(F.monotonically_increasing_id().alias("block"), "*").write.parquet(blocks)
    table = spark.read.parquet(blocks)
    numbers = [r.block for r in table.select("block").orderBy("block").collect()]
    if len(numbers) > 1:
        # So many to a file that tasks can share them.
        spread = scratch(spark, "leaf-blocks")
        table.repartition(min(len(numbers), _tasks(spark)), "block").sortWithinPartitions("block").write.parquet(spread)
        remove(spark, blocks)
        remove(spark, path)
        return Explainer(numbers, n_features, base, depth, spark.read.parquet(spread), (spread,))
    sent = [spark.sparkContext.broadcast(_shaped(r, depth)) for r in table.collect()]
    return Explainer(sent, n_features, base, depth)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shares(value: np.ndarray, cover: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """The formula above for every cell of `passed`; the last axis runs over a path's features."""
    depth = cover.shape[-1]
    nodes, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    inner = np.zeros(np.broadcast_shapes(cover.shape, passed.shape))
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = cover * (1 - t) + passed * t
        inner += w * factor.prod(axis=-1, keepdims=True) / factor
    return value * (passed - cover) * inner


def attributions(leaves: Leaves, x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values; they add up to prediction - base.

    A leaf only sees which of its d features pass, so for short paths the 2^d
    outcomes are worked out once and looked up. Leaves and rows are taken in
    blocks to bound memory.
    """
    n_leaves, depth = leaves.feature.shape
    out = np.zeros((len(x), leaves.n_features))
    outcomes = 2**depth
    by_lookup = depth <= LOOKUP_DEPTH  # a property of the model: digits don't depend on how rows are batched
    bits = (np.arange(outcomes)[:, None] >> np.arange(depth) & 1) if by_lookup else None
    block = max(1, CELLS_PER_LEAF_BLOCK // depth)
    for a in range(0, n_leaves, block):
        feature, low, high = (v[a : a + block] for v in (leaves.feature, leaves.low, leaves.high))
        cover, value = leaves.cover[a : a + block], leaves.value[a : a + block]
        n = len(feature)
        # The cells of a feature, whatever leaf they belong to, are added up side by side, row by row.
        by_feature = np.argsort(feature.ravel(), kind="stable")
        present, starts = np.unique(feature.ravel()[by_feature], return_index=True)
        if by_lookup:
            table = _shares(value[:, None, None], cover[:, None, :], bits[None]).reshape(n * outcomes, depth)
            first, place = np.arange(n) * outcomes, 1 << np.arange(depth)
        step = max(1, CELLS_PER_CHUNK // (n * depth))
        for r in range(0, len(x), step):
            part = x[r : r + step][:, feature]
            passed = (part > low) & (part <= high)
            phi = table[first + passed @ place] if by_lookup else _shares(value[:, None], cover, passed)
            out[r : r + step, present] += np.add.reduceat(phi.reshape(len(phi), -1)[:, by_feature], starts, axis=1)
    return out


def model_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node rows of a written node table, or of a saved MLlib ensemble or single tree stage."""
    names = ("treeID", "id", "leftChild", "rightChild", "prediction", "cover", "feature", "threshold")
    written = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if set(names) <= set(written.columns):
        return written.select(*names)
    data = spark.read.parquet(f"{path}/data")
    data = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.withColumn("treeID", F.lit(0))
    return data.select(
        "treeID",
        "id",
        "leftChild",
        "rightChild",
        "prediction",
        F.col("rawCount").cast("double").alias("cover"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def explain(rows: DataFrame, leaves: Explainer, features: tuple[str, ...], out: str = "contributions") -> DataFrame:
    """Add an array column with one contribution per feature and the constant base value.

    Attributions cost far more than moving a row, so rows are dealt out to as many tasks as the session shuffles into.
    """
    spark = rows.sparkSession
    # The code travels with the job; executors need numpy and pandas only.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    shipped, n_features, depth = leaves.blocks, leaves.n_features, leaves.depth
    dealt, kind = rows.repartition(_tasks(spark)), T.ArrayType(T.DoubleType())
    if leaves.table is not None:
        part = lambda block, x: attributions(Leaves(*_shaped(block, depth), n_features), x)

        def shape(total: np.ndarray, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * n_features, pa.array(total.ravel()))

        return crossed(dealt, features, leaves.table, part, shape, out, kind).withColumn("base_value", F.lit(leaves.base))
    flat = dealt.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))
    schema = flat.drop("_x").schema.add(out, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.pop("_x").to_numpy()) if len(batch) else np.empty((0, n_features))
            total = np.zeros((len(x), n_features))
            for block in shipped:
                total += attributions(Leaves(*block.value, n_features), x)
            batch[out] = list(total)
            yield batch

    return flat.mapInPandas(run, schema).withColumn("base_value", F.lit(leaves.base))
