"""Operator 6: near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.llm.common import components, settle
from cityflow.llm.simhash import _roots

#: Vectors of one tile on average.
TILE = 1024
#: Added to every bound: far above the rounding of sums in double precision.
SLACK = 1e-9


class Tile:
    """Vectors in full precision, and unit vectors as int8 values with a scale and an error each.

    A unit vector u is scale * q + e with integer q; ``error`` is |e| and ``norm`` is |scale * q|,
    so |u.v - su sv qu.qv| <= error_u * norm_v + norm_u * error_v + error_u * error_v.
    """

    def __init__(self, vectors: np.ndarray):
        # by a power of two, which changes no digit, so that no square is too large or too small for a double
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
        self.full = vectors
        self.length = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / np.abs(vectors).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(1))
        self.norm = np.sqrt((near * near).sum(1))

    def links(self, other: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (here, there) of cosine >= threshold; only pairs that the bound can't rule out are computed in full."""
        # products of int8 values add up exactly in float32 below 2**24, else in float64
        kind = np.float32 if 127 * 127 * self.q.shape[1] < 2**24 else np.float64
        product = (self.q.astype(kind) @ other.q.astype(kind).T).astype(np.float64)
        product *= self.scale[:, None] * other.scale[None, :]
        bound = self.error[:, None] * (other.norm + other.error)[None, :] + self.norm[:, None] * other.error[None, :]
        a, b = np.nonzero(product + bound + SLACK >= threshold)
        keep = [np.zeros(0, bool)]
        for at in range(0, len(a), 65536):
            x, y = a[at : at + 65536], b[at : at + 65536]
            dots = (self.full[x] * other.full[y]).sum(1)
            keep.append(dots / (self.length[x] * other.length[y]) >= threshold)
        keep = np.concatenate(keep)
        return a[keep], b[keep]


def _tile_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (label, dims, low, high); each pair of tiles is searched when it is whole."""
    held: list[tuple] = []
    last = None

    def unit() -> pa.RecordBatch:
        _, low, high = last
        sides = [[r[1:] for r in held if r[0] == part] for part in (low, high)]
        own, mult = ([np.array([r[i] for r in side], np.int64) for side in sides] for i in (0, 1))
        nodes, counts, roots = [], [], []
        if all(sides):
            a, b = (Tile(np.array([r[2] for r in side], np.float64)) for side in sides)
            x, y = a.links(b, threshold)
            if low == high:
                x, y = x[x != y], y[x != y]
            ids, place = np.unique(np.concatenate(own), return_inverse=True)
            px, py = place[: len(own[0])][x], place[len(own[0]) :][y]
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, px, mult[1][y])
            if low != high:
                np.add.at(count, py, mult[0][x])
            root = _roots(len(ids), iter([(px, py)]))
            some = np.flatnonzero(count)
            nodes, counts, roots = ids[some], count[some], ids[root[some]]
        columns = [pa.array(c, pa.int64()) for c in (nodes, counts, roots)]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "root"])

    for batch in batches:
        for label, low, high, own, node, mult, vector in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (label, low, high) != last:
                yield unit()
                held = []
            last = (label, low, high)
            held.append((own, node, mult, vector))
    if held:
        yield unit()


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows of equal, non-null labels and vectors of equal length are linked at a cosine of at least
    the threshold, in double precision; n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, kept says whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    no links, a group of their own. Equal vectors of a label are one node with a count, so copies
    never meet as pairs. Repeated rows are rows of their own. A null vec_id takes part, but is
    never a group's id. Extra columns are ignored; an empty table gives no rows.

    Each label is cut into tiles of about a thousand distinct vectors by a hash, and each pair of
    tiles is one unit of work, so a label that holds most rows is spread over many tasks. A unit
    multiplies int8 values, and recomputes only what its error bound can't rule out; it returns
    counts and one link per vector, not pairs.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("_sound", sound)
    plain = F.transform("embedding", lambda x: x + 0.0)  # -0.0 and 0.0 are one
    good = rows.where("_sound").select("vec_id", "label", plain.alias("embedding"))
    distinct = good.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    kind = F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("kind")
    parts = nodes.groupBy(kind).agg(F.greatest(F.lit(1), F.round(F.count("*") / TILE).cast("long")).alias("parts"))
    tiles = nodes.select(kind, "node", "copies", "embedding").join(parts, "kind")
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = tiles.select("kind", "own", "node", "copies", "embedding", other)
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    units = tiles.select("kind", low, high, "own", "node", "copies", "embedding")
    dealt = units.repartition("kind", "low", "high").sortWithinPartitions("kind", "low", "high")
    found = settle(dealt.mapInArrow(lambda it: _tile_pairs(it, threshold), "node long, n long, root long"), "vector-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-groups")
    counts = found.groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("_n"))
    named = (
        nodes.join(groups.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g"), "left")
        .join(counts, F.col("node") == F.col("_node"), "left")
        .withColumn("n_links", F.col("copies") - 1 + F.coalesce("_n", F.lit(0)))
        .select("label", "embedding", "first", "n_links", F.coalesce("component", "node").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = settle(named.join(least, "component").select("label", "embedding", "n_links", "component_id"), "vector-ids")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not _sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
