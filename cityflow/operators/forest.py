"""Random forests of regression trees, each grown where its rows are.

Rows are binned once (``boosting.binned``). A tree weighs each row by a Poisson draw and offers each of its nodes a third of the
features, drawn from the node's own number. Nodes are numbered like a heap: 1 is the root, 2n and 2n + 1 the children of n.
While a node has more rows than a task should hold, it is split by histograms that tasks add up; the rows of a smaller
node are brought together, and one task grows everything below it. Sums are integers, so the trees do not depend on
how rows are dealt out. The trees stay a table: the driver holds the nodes that were split by histograms, no others.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.operators import boosting
from cityflow.operators.boosting import FAN_IN, UNIT, Binned
from cityflow.operators.crossed import crossed
from cityflow.session import scratch

#: Rows of a node that one task grows, and bytes of the histograms of one job.
LOCAL_ROWS, HISTOGRAM_BYTES = 1 << 17, 1 << 26
MAX_BINS = 32
TREE = "treeID int, depth int, nodes int, id binary, leftChild binary, rightChild binary, feature binary, threshold binary, prediction binary, cover binary, gain binary"
KINDS = dict(id="i4", leftChild="i4", rightChild="i4", feature="i4", threshold="f8", prediction="f8", cover="f8", gain="f8")


@dataclass(frozen=True)
class Settings:
    numTrees: int = 20
    maxDepth: int = 5
    minInstancesPerNode: int = 1
    seed: int = 42


@dataclass
class Top:
    """Nodes of a tree that were split by histograms, sorted; and those whose rows one task can hold."""

    heap: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    done: list = field(default_factory=list)  # node columns: heap, feature, bin, sum, count, gain

    def add(self, columns: tuple) -> None:
        self.done.append(columns)
        heap, feature, cut = (np.concatenate([c[i] for c in self.done]) for i in range(3))
        order = np.argsort(heap)
        self.heap, self.feature, self.bin = heap[order], feature[order], cut[order]

    def routes(self) -> tuple:
        return self.heap, self.feature, self.bin


def _routed(codes: np.ndarray, heap: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node below the split ones that each row comes to."""
    at = np.ones(len(codes), np.int64)
    rows = np.arange(len(codes))
    while len(heap) and len(rows):
        place = np.minimum(np.searchsorted(heap, at[rows]), len(heap) - 1)
        inner = (heap[place] == at[rows]) & (feature[place] >= 0)
        rows, place = rows[inner], place[inner]
        at[rows] = 2 * at[rows] + (codes[rows, feature[place]] > cut[place])
    return at


def _offered(seed: int, tree: int, heap: np.ndarray, features: int) -> np.ndarray:
    """The features offered to each node: a third, in ascending order, by a hash of the seed, tree, node and feature."""
    with np.errstate(over="ignore"):
        z = heap.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(features, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        z = z + np.uint64((seed * 1_000_003 + tree + 1) * 0x8CB92BA72F3D8DD7 % 2**64)
        for _ in range(2):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return np.sort(np.argsort(z, axis=1, kind="stable")[:, : math.ceil(features / 3)], axis=1)


def _drawn(s: Settings, tree: int, key: tuple, n: int) -> np.ndarray:
    """How often each row of a block is in the tree's sample."""
    return np.random.default_rng([s.seed, tree, *key]).poisson(1.0, n)


def _tally(codes: np.ndarray, slot: np.ndarray, offer: np.ndarray, weight: np.ndarray, target: np.ndarray, bins: int) -> Iterator[tuple]:
    """For each feature that is offered, (nodes, bins) of summed targets and of row counts."""
    nodes, flat = len(offer), codes.ravel()
    start, base = np.arange(len(codes)) * codes.shape[1], slot * bins
    for j in range(offer.shape[1]):
        place = base + flat[start + offer[:, j][slot]]
        yield tuple(np.bincount(place, v, nodes * bins).reshape(nodes, bins) for v in (target, weight))


def _best(tallies: Iterator[tuple], offer: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin) of the best split of each node: what it takes off the squared error."""
    gain, column, cut = np.zeros(len(offer)), np.zeros(len(offer), np.int64), np.zeros(len(offer), np.int64)
    every = np.arange(len(offer))
    for j, (g, n) in enumerate(tallies):
        g, n = g.cumsum(1) * UNIT, n.cumsum(1)
        all_g, all_n = g[:, -1:], n[:, -1:]
        right = all_n - n
        found = g * g / np.maximum(n, 1) + (all_g - g) ** 2 / np.maximum(right, 1) - all_g * all_g / np.maximum(all_n, 1)
        found = np.where((n >= max(least, 1)) & (right >= max(least, 1)), found, 0.0)
        at = found.argmax(1)
        most = found[every, at]
        better = most > np.maximum(gain, 1e-9)
        gain, cut = np.where(better, most, gain), np.where(better, at, cut)
        column = np.where(better, offer[:, j], column)
    return gain, column, cut


def _grown(codes: np.ndarray, weight: np.ndarray, label: np.ndarray, root: int, s: Settings, tree: int, bins: int) -> tuple:
    """Node columns of everything below and with the root, level by level."""
    some = np.flatnonzero(weight)
    codes, weight = np.ascontiguousarray(codes[some]), weight[some].astype(np.float64)
    target = label[some] * weight  # whole numbers
    heap, slot, out = np.array([root], np.int64), np.zeros(len(some), np.int64), []
    for level in range(root.bit_length() - 1, s.maxDepth + 1):
        total, count = (np.bincount(slot, v, len(heap)) for v in (target, weight))
        gain, feature, cut = np.zeros(len(heap)), np.full(len(heap), -1), np.zeros(len(heap), np.int64)
        if level < s.maxDepth:
            open_ = np.flatnonzero(count >= 2 * s.minInstancesPerNode)
            rank = np.full(len(heap), -1)
            rank[open_] = np.arange(len(open_))
            kept = rank[slot] >= 0
            codes, weight, target, slot = codes[kept], weight[kept], target[kept], slot[kept]
            if len(open_):
                offer = _offered(s.seed, tree, heap[open_], codes.shape[1])
                most, column, at = _best(_tally(codes, rank[slot], offer, weight, target, bins), offer, s.minInstancesPerNode)
                gain[open_], feature[open_], cut[open_] = most, np.where(most > 0, column, -1), at
        out.append((heap, feature, cut, total, count, gain))
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        rank = np.full(len(heap), -1)
        rank[split] = np.arange(len(split))
        kept = rank[slot] >= 0
        codes, weight, target, slot = codes[kept], weight[kept], target[kept], slot[kept]
        right = codes[np.arange(len(codes)), feature[slot]] > cut[slot]
        slot = 2 * rank[slot] + right
        heap = np.stack([2 * heap[split], 2 * heap[split] + 1], 1).ravel()
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6))


def _units(label: np.ndarray, base: float) -> np.ndarray:
    return np.rint((label - base) / UNIT)


def _row(tree: int, parts: list[tuple], edges: list[np.ndarray], base: float) -> tuple:
    """The table row of a tree from the node columns of its parts; ids follow the order of the heap."""
    heap, feature, cut, total, count, gain = (np.concatenate([p[i] for p in parts]) for i in range(6))
    order = np.argsort(heap, kind="stable")
    heap, feature, cut, total, count, gain = (v[order] for v in (heap, feature, cut, total, count, gain))
    inner = feature >= 0
    child = lambda h: np.where(inner, np.searchsorted(heap, h), -1)
    threshold = np.array([edges[f][b] if f >= 0 and b < len(edges[f]) else np.inf for f, b in zip(feature, cut)])
    columns = dict(
        id=np.arange(len(heap)), leftChild=child(2 * heap), rightChild=child(2 * heap + 1), feature=feature, threshold=threshold,
        prediction=base + total * UNIT / np.maximum(count, 1), cover=count, gain=gain,
    )
    return (tree, int(heap[-1]).bit_length() - 1, len(heap), *[columns[k].astype(t).tobytes() for k, t in KINDS.items()])


def _split_large(data: Binned, s: Settings, bins: int) -> tuple[list[Top], list[tuple[int, int]]]:
    """Split nodes by histograms level by level until tasks can hold the rest: the tops, and (tree, node) of the rest."""
    features, base, tops, small = len(data.features), data.mean, [Top() for _ in range(s.numTrees)], []
    width = math.ceil(features / 3)
    step = max(1, HISTOGRAM_BYTES // (width * bins * 16))
    work = [(t, 1) for t in range(s.numTrees)]
    while work:
        below = []
        for a in range(0, len(work), step):
            trees: dict[int, list[int]] = {}
            for t, h in work[a : a + step]:
                trees.setdefault(t, []).append(h)
            asked = [(t, tops[t].routes(), np.array(sorted(h))) for t, h in trees.items()]

            def sums(blocks: Iterator, asked=asked) -> Iterator:
                total = None
                for key, codes, label, fit, *_ in blocks:
                    parts = []
                    for t, routes, heap in asked:
                        weight = _drawn(s, t, key, len(fit)) * fit
                        at = _routed(codes, *routes)
                        slot = np.minimum(np.searchsorted(heap, at), len(heap) - 1)
                        some = np.flatnonzero((heap[slot] == at) & (weight > 0))
                        offer, w = _offered(s.seed, t, heap, codes.shape[1]), weight[some].astype(np.float64)
                        both = _tally(codes[some], slot[some], offer, w, _units(label[some], base) * w, bins)
                        parts.append(np.stack([np.stack(b) for b in both]).astype(np.int64))  # (offered, 2, nodes, bins)
                    found = np.concatenate(parts, 2)
                    total = found if total is None else total + found
                if total is not None:
                    yield total

            rounds = max(1, math.ceil(math.log(max(2, data.blocks.getNumPartitions()), FAN_IN)))
            found, place = data.blocks.mapPartitions(sums).treeReduce(lambda x, y: x + y, rounds), 0
            for t, _, heap in asked:
                own = found[:, :, place : place + len(heap)].astype(np.float64)
                place += len(heap)
                offer = _offered(s.seed, t, heap, features)
                gain, column, cut = _best(((o[0], o[1]) for o in own), offer, s.minInstancesPerNode)
                total, count = own[0, 0].sum(1), own[0, 1].sum(1)
                large = (count > LOCAL_ROWS) & np.array([int(h).bit_length() - 1 < s.maxDepth for h in heap])
                small += [(t, int(h)) for h in heap[~large]]
                feature = np.where(gain > 0, column, -1)[large]
                tops[t].add((heap[large], feature, cut[large], total[large], count[large], gain[large]))
                for h in heap[large][feature >= 0]:
                    below += [(t, 2 * int(h)), (t, 2 * int(h) + 1)]
        work = below
    return tops, small


def fit_forest(data: Binned, s: Settings) -> Forest:
    """Grow all trees and write them as a table."""
    spark, edges, base = data.spark, data.edges, data.mean
    for module in (sys.modules[__name__], boosting):
        cloudpickle.register_pickle_by_value(module)
    bins, sc = max(len(e) for e in edges) + 1, spark.sparkContext
    tasks = max(1, min(s.numTrees, max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if data.blocks.getNumPartitions() == 1:

        def whole(pair: tuple) -> tuple:
            tree, blocks = pair
            codes, label, fit = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3))
            weight = np.concatenate([_drawn(s, tree, b[0], len(b[3])) for b in blocks]) * fit
            return _row(tree, [_grown(codes, weight, _units(label, base), 1, s, tree, bins)], edges, base)

        rows = sc.parallelize(range(s.numTrees), tasks).cartesian(data.blocks.glom()).map(whole)
    else:
        tops, small = _split_large(data, s, bins)
        shipped = sc.broadcast(([t.routes() for t in tops], [t.done for t in tops], set(small)))

        def dealt(block: tuple) -> Iterator[tuple]:
            key, codes, label, fit = block[:4]
            target = _units(label, base)
            for tree, routes in enumerate(shipped.value[0]):
                weight = _drawn(s, tree, key, len(fit)) * fit
                at = _routed(codes, *routes)
                some = np.flatnonzero(weight)
                some = some[np.argsort(at[some], kind="stable")]
                heaps, starts = np.unique(at[some], return_index=True)
                for h, own in zip(heaps.tolist(), np.split(some, starts[1:])):
                    if (tree, h) in shipped.value[2]:
                        yield (tree, h), (codes[own], weight[own].astype(np.uint8), target[own])

        def subtree(item: tuple) -> tuple:
            (tree, root), parts = item
            parts = list(parts)
            codes, weight, target = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return tree, _grown(codes, weight, target, root, s, tree, bins)

        def joined(item: tuple) -> tuple:
            tree, parts = item
            return _row(tree, [*shipped.value[1][tree], *parts], edges, base)

        rows = data.blocks.flatMap(dealt).groupByKey(tasks).map(subtree)
        tree_tops = sc.parallelize([(t, None) for t in range(s.numTrees)], 1)
        rows = rows.union(tree_tops).groupByKey(tasks).map(lambda i: joined((i[0], [p for p in i[1] if p is not None])))
    path = scratch(spark, "forest")
    spark.createDataFrame(rows, TREE).write.parquet(path)
    return Forest(spark, data.features, s, path)


def _predicted(tree: tuple, x: np.ndarray) -> np.ndarray:
    """What one tree predicts for a matrix of raw feature values; NaN goes right."""
    get = {k: np.frombuffer(v, t) for (k, t), v in zip(KINDS.items(), tree[1:])}
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[get["leftChild"][at[rows]] >= 0]
        here = at[rows]
        down = x[rows, get["feature"][here]] <= get["threshold"][here]
        at[rows] = np.where(down, get["leftChild"][here], get["rightChild"][here])
    return get["prediction"][at]


@dataclass
class Forest:
    """A fitted forest; its trees are a table, one row for each."""

    spark: SparkSession
    features: tuple[str, ...]
    settings: Settings
    path: str

    @property
    def stages(self) -> list[Forest]:
        return [self]

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(self.path)

    @property
    def trees(self) -> list:
        """(treeID, depth, nodes) of each tree."""
        return self.table.select("treeID", "depth", "nodes").orderBy("treeID").collect()

    @property
    def params(self) -> dict:
        s = self.settings
        return dict(
            numTrees=s.numTrees, maxDepth=s.maxDepth, minInstancesPerNode=s.minInstancesPerNode, maxBins=MAX_BINS, seed=s.seed,
            impurity="variance", featureSubsetStrategy="onethird", bootstrap=True, subsamplingRate=1.0, minInfoGain=0.0,
        )

    @property
    def importance(self) -> np.ndarray:
        """Each feature's share of what splits gain, averaged over the trees."""
        gains = self.nodes().where("leftChild >= 0").groupBy("treeID", "feature").agg(F.sum("gain").alias("gain"))
        shares = gains.join(gains.groupBy("treeID").agg(F.sum("gain").alias("whole")), "treeID")
        out = np.zeros(len(self.features))
        for r in shares.groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share")).collect():
            out[r.feature] = r.share
        return out / max(out.sum(), 1e-300)

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with a ``prediction``, the mean of all trees; features that the table lacks are 0."""
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        n = self.settings.numTrees
        return crossed(
            rows, self.features, self.table.select("treeID", *KINDS), _predicted,
            lambda total, _: pa.array(total / n), "prediction", T.DoubleType(),
        )

    def nodes(self) -> DataFrame:
        """One row per node, like the node table of a saved forest: a leaf's children are -1."""
        kinds = ", ".join(["treeID int", *[f"{k} {'int' if t == 'i4' else 'double'}" for k, t in KINDS.items()]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    columns = [np.frombuffer(batch.column(i + 1)[r].as_buffer(), t) for i, t in enumerate(KINDS.values())]
                    trees = np.full(len(columns[0]), batch.column(0)[r].as_py(), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (trees, *columns)], ["treeID", *KINDS])

        return self.table.select("treeID", *KINDS).mapInArrow(run, kinds)

    def save(self, path: str) -> None:
        s = self.settings
        about = [(list(self.features), s.numTrees, s.maxDepth, s.minInstancesPerNode, s.seed)]
        kinds = "features array<string>, numTrees int, maxDepth int, minInstancesPerNode int, seed int"
        self.spark.createDataFrame(about, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        self.table.write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        features, *numbers = spark.read.parquet(f"{path}/about").first()
        return Forest(spark, tuple(features), Settings(*numbers), f"{path}/trees")
