"""Gradient boosting of regression trees, round by round, with patience on validation rows.

Rows are binned once: every feature becomes the number of a quantile range. The binned rows, their labels and
what the rounds so far predict for them stay cached in blocks, part by part. A level of a tree is one job: each
task adds up gradients and row counts by (node, feature, bin) over its blocks, partial sums are reduced in a
tree of tasks, and the driver, which gets one histogram of nodes x bins of all features, picks the splits. Only the
smaller child of a split is summed up; its sibling is the rest of the parent. Gradients are summed as integers, so
the trees do not depend on how rows are dealt out or in which order sums arrive.

The first job of a round also measures the rounds so far on the validation rows, so boosting stops as soon as
patience runs out, without a fit of all rounds. Cached blocks are an RDD, since a fit takes thousands of short jobs. Rows
that fit one task are boosted inside it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.session import checkpoints, remove

#: Rows of a block and of a task, at least; a table with more partitions keeps them.
BLOCK_ROWS, TASK_ROWS = 1 << 16, 1 << 17
#: Partial histograms that one task adds up, and rounds after which the lineage of the cached blocks is cut.
FAN_IN, CUT_AFTER = 32, 16
#: Gradients are summed in units of this size.
UNIT = 2.0**-16
ACCURACY = 10_000
#: Trees x rows walked at once.
CELLS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """What a fit is asked for; ``leaves`` bounds the leaves of a tree, ``patience`` needs validation rows."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    least: float = 1.0
    alpha: float = 0.0
    penalty: float = 0.0
    leaves: int | None = None
    patience: int | None = None
    seed: int = 42


@dataclass
class Trees:
    """Nodes of all trees in one numbering; a leaf has feature -1 and is its own child."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf(self, bins: np.ndarray, steps: int) -> np.ndarray:
        """The node that each row of one tree has come to after so many steps from the root, node 0."""
        node, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
        for _ in range(steps):
            down = bins[rows, np.maximum(self.feature[node], 0)] <= self.bin[node]
            node = np.where(down, self.left[node], self.right[node])
        return node


@dataclass
class Binned:
    """Binned rows and the upper edges of the bins of every feature."""

    spark: SparkSession
    features: tuple[str, ...]
    edges: list[np.ndarray]
    blocks: RDD
    mean: float
    validation: int

    def unpersist(self) -> None:
        self.blocks.unpersist()


@dataclass
class Boosted:
    """A fitted ensemble: the sum of a base value and one leaf of every tree."""

    features: tuple[str, ...]
    settings: Settings
    base: float
    tree: np.ndarray
    node: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    errors: list[float] = field(default_factory=list)

    @property
    def importance(self) -> np.ndarray:
        """Each feature's share of what all splits gain."""
        found = np.bincount(np.maximum(self.feature, 0), self.gain, len(self.features))
        return found / max(found.sum(), 1e-300)

    @property
    def rounds(self) -> int:
        return int(self.tree.max()) + 1 if len(self.tree) else 0

    @property
    def params(self) -> dict:
        return asdict(self.settings) | {"kept": self.rounds}

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with a ``prediction``; features that the table lacks are 0."""
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        arrays = (self.base, self.tree, self.node, self.left, self.right, self.feature, self.threshold, self.value)
        shipped = rows.sparkSession.sparkContext.broadcast(arrays)  # as large as the model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = predicted(_matrix(batch.column(batch.num_columns - 1)), *shipped.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "prediction"])

        kinds = T.StructType([*rows.schema.fields]).add("prediction", T.DoubleType())
        return rows.withColumn("_x", _values(rows, self.features)).mapInArrow(run, kinds)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node, like the node table of a saved forest: a leaf's children are -1."""
        columns = dict(
            treeID=self.tree, id=self.node, leftChild=self.left, rightChild=self.right, prediction=self.value,
            cover=self.cover, gain=self.gain, feature=self.feature, threshold=self.threshold,
        )
        return spark.createDataFrame(pa.table(columns))

    def save(self, spark: SparkSession, path: str) -> None:
        about = [(list(self.features), float(self.base), {k: str(v) for k, v in asdict(self.settings).items()}, [float(e) for e in self.errors])]
        kinds = "features array<string>, base double, settings map<string,string>, errors array<double>"
        spark.createDataFrame(about, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        about = spark.read.parquet(f"{path}/about").first()
        kinds = {f: type(v) for f, v in asdict(Settings()).items()} | {"leaves": int, "patience": int}
        settings = Settings(**{k: None if v == "None" else kinds[k](v) for k, v in about.settings.items()})
        n = spark.read.parquet(f"{path}/nodes").orderBy("treeID", "id").toArrow()
        get = lambda c: n[c].to_numpy()
        return Boosted(
            tuple(about.features), settings, about.base, get("treeID"), get("id"), get("leftChild"), get("rightChild"),
            get("feature"), get("threshold"), get("prediction"), get("cover"), get("gain"), list(about.errors),
        )


def predicted(x: np.ndarray, base: float, tree, node, left, right, feature, threshold, value) -> np.ndarray:
    """Predictions for a matrix of raw feature values; NaN goes right."""
    starts = np.flatnonzero(np.diff(tree, prepend=-1))
    place = np.repeat(starts, np.diff(np.append(starts, len(tree))))
    down, up = (np.where(side < 0, node, side) + place for side in (left, right))
    column, out = np.maximum(feature, 0), np.full(len(x), float(base))
    step = max(1, CELLS // max(1, len(starts)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        rows, here, last = np.arange(len(part))[:, None], np.tile(starts, (len(part), 1)), None
        while last is None or (here != last).any():
            last = here
            here = np.where(part[rows, column[last]] <= threshold[last], down[last], up[last])
        out[at : at + step] += value[here].sum(1)
    return out


def _values(rows: DataFrame, features: tuple[str, ...]) -> Column:
    return F.array(*[F.col(c).cast("double") if c in rows.columns else F.lit(0.0) for c in features])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


# ---- binning -----------------------------------------------------------------


def binned(rows: DataFrame, features: tuple[str, ...], label: str, validation: Column | None = None, bins: int = 128) -> Binned:
    """Bin the rows by quantiles of each feature over the rows that are not for validation, and cache them.

    Rows without a label are left out. At most 256 bins; null and NaN features lie in the last one. One aggregate
    gives the edges, one pass the blocks.
    """
    spark = rows.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the code travels with the jobs
    held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    rows = rows.where(F.col(label).isNotNull())
    shares = [i / bins for i in range(1, bins)]
    fitted = F.when(~held, F.lit(1))
    value = lambda c: F.when(~held & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(
        F.count(fitted), F.avg(F.when(~held, F.col(label).cast("double"))), F.count("*"),
        *[F.percentile_approx(value(c), shares, ACCURACY) for c in features],
    ).first()
    n, total = found[0], found[2]
    if not n:
        raise ValueError("no rows to fit")
    edges = [np.unique(np.array(e or [0.0])) for e in found[3:]]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            number = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)
            y, v = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            columns = [pa.array([a.tobytes()], pa.binary()) for a in (number, y, v.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(columns, ["bins", "label", "held"])

    parts = max(1, min(rows.rdd.getNumPartitions(), -(-total // TASK_ROWS)))
    plain = rows.select(_values(rows, features).alias("x"), F.col(label).cast("double").alias("y"), held.alias("held"))
    packed = plain.coalesce(parts).mapInArrow(blocks, "bins binary, label binary, held binary")

    def unpack(part: int, found: Iterator) -> Iterator[tuple]:
        for i, row in enumerate(found):
            bins = np.frombuffer(row.bins, np.uint8).reshape(-1, len(features))
            yield (part, i), bins, np.frombuffer(row.label), np.frombuffer(row.held, np.uint8) == 0

    cached = packed.rdd.mapPartitionsWithIndex(unpack, True).persist(StorageLevel.MEMORY_AND_DISK)
    return Binned(spark, tuple(features), edges, cached, found[1], total - n)


# ---- one round -----------------------------------------------------------------


def _totals(
    codes: np.ndarray, columns: np.ndarray, some: np.ndarray, at: np.ndarray, gradient: np.ndarray, slots: int, widths: np.ndarray
) -> np.ndarray:
    """(2, slots, bins) sums of the gradients and counts of some rows, the bins of the drawn columns side by side.

    ``codes`` has one row per feature, ``widths`` its number of bins. Where whole numbers hold both, one sum gives
    gradients and counts.
    """
    out, begin = np.zeros((2, slots, widths[columns].sum()), np.int64), 0
    unit = float(1 << len(some).bit_length())  # more than any count
    joint = np.abs(gradient).sum() * unit < 2.0**52
    both = gradient * unit + 1 if joint else None
    for f in columns:
        width = int(widths[f])
        place, to = at * width + codes[f][some], np.s_[:, begin : begin + width]
        begin += width
        if joint:
            found = np.bincount(place, both, slots * width).reshape(slots, width)
            out[0][to] = g = np.floor(found / unit)
            out[1][to] = found - g * unit
        else:
            out[0][to] = np.bincount(place, gradient, slots * width).reshape(slots, width)
            out[1][to] = np.bincount(place, minlength=slots * width).reshape(slots, width)
    return out


def _in_sample(draw: tuple, key: tuple, fit: np.ndarray) -> np.ndarray:
    share, seed, number = draw
    return fit if share >= 1 else fit & (np.random.default_rng([seed, number, *key]).random(len(fit)) < share)


def _sums(
    blocks: Iterator, tree: Trees, steps: int, slot: np.ndarray, slots: int, widths: np.ndarray, draw: tuple, columns: np.ndarray, measure: bool
) -> Iterator:
    """Partial histogram of gradients and counts, and the squared error of validation rows."""
    total, error = None, 0.0
    for key, codes, label, fit, margin in blocks:
        if measure:
            error += float(((label - margin)[~fit] ** 2).sum())
        at = slot[tree.leaf(codes, steps)]
        some = np.flatnonzero(_in_sample(draw, key, fit) & (at >= 0))
        gradient = np.rint((margin[some] - label[some]) / UNIT)
        found = _totals(codes.T, columns, some, at[some].astype(np.int64), gradient, slots, widths)
        total = found if total is None else total + found
    if total is not None:
        yield total, error


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _advance(tree: Trees, steps: int) -> Callable:
    """Blocks with what one more tree predicts."""
    return lambda b: (*b[:4], b[4] + tree.value[tree.leaf(b[1], steps)])


class Held:
    """Blocks of one task, in the task: feature by feature, and with the node that each row has come to.

    The levels of a tree come in order, so a row takes one step for each, and a round's sample and gradients are
    worked out once.
    """

    def __init__(self, blocks: list[tuple], base: float):
        self.keys, sizes = [b[0] for b in blocks], [len(b[2]) for b in blocks]
        self.parts = [slice(e - n, e) for e, n in zip(np.cumsum(sizes).tolist(), sizes)]
        self.codes = np.ascontiguousarray(np.concatenate([b[1] for b in blocks]).T)
        self.label, self.fit = (np.concatenate([b[i] for b in blocks]) for i in (2, 3))
        self.margin, self.rows = np.full(len(self.label), base), np.arange(len(self.label))
        self._start()

    def _start(self) -> None:
        self.node, self.steps, self.draw = np.zeros(len(self.label), np.int32), 0, None

    def _walk(self, tree: Trees, steps: int) -> None:
        for _ in range(self.steps, steps):
            down = self.codes[np.maximum(tree.feature[self.node], 0), self.rows] <= tree.bin[self.node]
            self.node = np.where(down, tree.left[self.node], tree.right[self.node])
        self.steps = steps

    def histogram(
        self, tree: Trees, steps: int, slot: np.ndarray, slots: int, widths: np.ndarray, draw: tuple, columns: np.ndarray, measure: bool
    ) -> tuple[np.ndarray, float]:
        error = 0.0
        if measure:
            for p in self.parts:
                error += float(((self.label[p] - self.margin[p])[~self.fit[p]] ** 2).sum())
        if self.draw != draw:
            self._start()
            self.draw = draw
            self.used = np.concatenate([_in_sample(draw, k, self.fit[p]) for k, p in zip(self.keys, self.parts)])
            self.gradient = np.rint((self.margin - self.label) / UNIT)
        self._walk(tree, steps)
        at = slot[self.node]
        some = np.flatnonzero(self.used & (at >= 0))
        return _totals(self.codes, columns, some, at[some].astype(np.int64), self.gradient[some], slots, widths), error

    def advance(self, tree: Trees, steps: int) -> None:
        self._walk(tree, steps)
        self.margin = self.margin + tree.value[self.node]
        self._start()

    def close(self) -> None:
        self.codes = None


class Spread:
    """Blocks of many tasks, cached with what the rounds so far predict; seen from the driver.

    The lineage is cut by a checkpoint every few rounds; blocks and files that nothing needs any more are dropped.
    """

    def __init__(self, spark: SparkSession, blocks: RDD, base: float):
        self.spark, self.before, self.files, self.rounds = spark, None, [], 0
        self.state = self._cached(blocks.map(lambda b: (*b, np.full(len(b[2]), base)), True))
        checkpoints(spark)

    @staticmethod
    def _cached(blocks: RDD) -> RDD:
        return blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def histogram(self, *args) -> tuple[np.ndarray, float]:
        parts = self.state.mapPartitions(lambda it: _sums(it, *args))
        found = parts.treeReduce(_added, max(1, math.ceil(math.log(self.state.getNumPartitions(), FAN_IN))))
        if self.before:  # the blocks stand now without those of the round before
            self.before.unpersist()
            self.before = None
        written = self.state.getCheckpointFile()
        if written and written not in self.files:
            self._remove()
            self.files = [written]
        return found

    def advance(self, tree: Trees, steps: int) -> None:
        self.before, self.state = self.state, self._cached(self.state.map(_advance(tree, steps), True))
        self.rounds += 1
        if self.rounds % CUT_AFTER == 0:
            self.state.checkpoint()

    def _remove(self) -> None:
        for file in self.files:
            remove(self.spark, file)

    def close(self) -> None:
        for blocks in (self.before, self.state):
            if blocks:
                blocks.unpersist()
        self._remove()


def _soft(gradient: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0) if alpha else gradient


def _score(gradient: np.ndarray, count: np.ndarray, s: Settings) -> np.ndarray:
    return _soft(gradient, s.alpha) ** 2 / np.maximum(count + s.penalty, 1e-12)


def _splits(histogram: np.ndarray, total: np.ndarray, columns: np.ndarray, widths: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, sums to the left) of the best split of each node; gain 0 where none helps."""
    wide = widths[columns]
    column = np.repeat(np.arange(len(columns)), wide)
    left = histogram.cumsum(2) - column * total[:, :, None]  # each feature's bins add up to the node's total
    g, n = left[0] * UNIT, left[1].astype(np.float64)
    all_g, all_n = total[0][:, None] * UNIT, total[1][:, None].astype(np.float64)
    gain = _score(g, n, s) + _score(all_g - g, all_n - n, s) - _score(all_g, all_n, s)
    least = max(s.least, 1)
    gain = np.where((n >= least) & (all_n - n >= least), gain, 0.0)
    best, every = gain.argmax(1), np.arange(len(gain))
    most = gain[every, best]
    starts = np.cumsum(wide) - wide
    return np.where(most > 1e-9, most, 0.0), columns[column[best]], best - starts[column[best]], left[:, every, best]


def _stump() -> Trees:
    leaf, place = np.full(1, -1, np.int32), np.zeros(1, np.int32)
    return Trees(leaf, leaf.copy(), place, place.copy(), np.zeros(1), np.zeros(1), np.zeros(1))


def _grown(rows: Held | Spread, s: Settings, number: int, widths: np.ndarray, measure: bool) -> tuple[Trees, float]:
    """One tree, level by level, and the validation error of the rounds before it.

    If leaves are bounded, a level's splits of highest gain go first while the bound lasts.
    """
    rng = np.random.default_rng([s.seed, number])
    columns = np.sort(rng.permutation(len(widths))[: max(1, math.ceil(s.columns * len(widths)))])
    tree = _stump()
    draw = (s.rows, s.seed, number)
    sums, error = rows.histogram(tree, 0, np.zeros(1, np.int32), 1, widths, draw, columns, measure)
    open_nodes, totals = np.zeros(1, np.int32), sums[:, :, : widths[columns[0]]].sum(2)
    leaves = 1
    for level in range(s.depth + 1):
        g, n = totals[0] * UNIT, totals[1].astype(np.float64)
        tree.value[open_nodes] = -s.rate * _soft(g, s.alpha) / np.maximum(n + s.penalty, 1e-12)
        tree.cover[open_nodes] = n
        if level == s.depth:
            break
        gain, feature, cut, below = _splits(sums, totals, columns, widths, s)
        chosen = np.flatnonzero(gain > 0)
        if s.leaves is not None:
            chosen = np.sort(chosen[np.argsort(-gain[chosen], kind="stable")][: max(0, s.leaves - leaves)])
        if not len(chosen):
            break
        leaves += len(chosen)
        parents, size = open_nodes[chosen], len(tree.feature)
        left = size + 2 * np.arange(len(chosen), dtype=np.int32)
        tree.feature[parents], tree.bin[parents] = feature[chosen], cut[chosen]
        tree.left[parents], tree.right[parents] = left, left + 1
        fresh = np.arange(size, size + 2 * len(chosen), dtype=np.int32)
        tree.feature, tree.bin = (np.append(a, np.full(len(fresh), -1, np.int32)) for a in (tree.feature, tree.bin))
        tree.left, tree.right = np.append(tree.left, fresh), np.append(tree.right, fresh)
        tree.gain[parents] = gain[chosen]
        tree.value, tree.cover, tree.gain = (np.append(a, np.zeros(len(fresh))) for a in (tree.value, tree.cover, tree.gain))
        open_nodes = fresh
        below, whole = below[:, chosen], totals[:, chosen]
        totals = np.stack([below, whole - below], 2).reshape(2, -1)
        if level + 1 == s.depth:  # the last level needs totals only
            continue
        right_small = 2 * below[1] > whole[1]
        slot = np.full(len(tree.feature), -1, np.int32)
        slot[left + right_small] = np.arange(len(chosen))
        small, _ = rows.histogram(tree, level + 1, slot, len(chosen), widths, draw, columns, False)
        rest, swap = sums[:, chosen] - small, right_small[:, None]
        sums = np.empty((2, 2 * len(chosen), small.shape[2]), np.int64)
        sums[:, 0::2], sums[:, 1::2] = np.where(swap, rest, small), np.where(swap, small, rest)
    return tree, error


def _rounds(
    rows: Held | Spread, s: Settings, bins: int | list[int], features: int, validation: int
) -> tuple[list[Trees], list[float]]:
    """The trees that are kept, and the validation error after each round that was run; ``bins`` is one number for all
    features or one for each."""
    widths = np.broadcast_to(np.asarray(bins, np.int64), features)
    trees, errors, best, measure = [], [], 0, s.patience is not None
    while True:
        if len(trees) < s.rounds:
            tree, error = _grown(rows, s, len(trees), widths, measure)
        elif measure:
            _, error = rows.histogram(_stump(), 0, np.full(1, -1), 1, widths, (1.0, 0, 0), np.zeros(1, int), True)
        if measure and trees:
            errors.append(math.sqrt(error / validation))
            best = len(errors) if errors[-1] < min(errors[:-1], default=math.inf) else best
        if len(trees) == s.rounds or measure and len(errors) - best >= s.patience:
            return trees[:best] if measure else trees, errors
        trees.append(tree)
        rows.advance(tree, s.depth)


def boost(data: Binned, settings: Settings) -> Boosted:
    """Fit round by round; with patience, up to the last round that was better on the validation rows than all rounds
    before it, which is known once so many rounds have brought no gain. ``errors`` lists the validation error (rmse)
    after each round that was fitted.

    Rows of one task are boosted inside that task, and several fits of them side by side; otherwise each level
    is a job over all tasks. Both give the same trees.
    """
    s = settings
    if s.patience is not None and not data.validation:
        raise ValueError("patience needs validation rows")
    base, shape = data.mean, ([len(e) + 1 for e in data.edges], len(data.features), data.validation)
    if data.blocks.getNumPartitions() == 1:
        [(trees, errors)] = data.blocks.mapPartitions(lambda it: [_rounds(Held(list(it), base), s, *shape)]).collect()
    else:
        rows = Spread(data.spark, data.blocks, base)
        try:
            trees, errors = _rounds(rows, s, *shape)
        finally:
            rows.close()
    return _ensemble(data, s, base, trees, errors)


def _ensemble(data: Binned, s: Settings, base: float, trees: list[Trees], errors: list[float]) -> Boosted:
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    leaf = [t.feature < 0 for t in trees]
    edges = [
        np.array([data.edges[f][b] if f >= 0 and b < len(data.edges[f]) else np.inf for f, b in zip(t.feature, t.bin)]) for t in trees
    ]
    return Boosted(
        data.features, s, base,
        join([np.full(len(t.feature), i) for i, t in enumerate(trees)], np.int32),
        join([np.arange(len(t.feature)) for t in trees], np.int32),
        join([np.where(x, -1, t.left) for t, x in zip(trees, leaf)], np.int32),
        join([np.where(x, -1, t.right) for t, x in zip(trees, leaf)], np.int32),
        join([t.feature for t in trees], np.int32),
        join(edges, float), join([t.value for t in trees], float), join([t.cover for t in trees], float),
        join([t.gain for t in trees], float), errors,
    )
