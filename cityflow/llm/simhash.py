"""Operator 4: SimHash near-duplicates, found with BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityflow.llm.common import components, settle, texts

BITS = 64
#: Fingerprints of one shard tree, and probes that one task unit sends through it, on average.
SHARD = 2048
#: Shingles hashed at once.
STRIDE = 1 << 20


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; 0 without words.

    A-Z are lowered, words are split at ASCII white space, repeated shingles count again, a text
    of fewer words is one shingle. A bit is set if more than half the shingle hashes have it.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    words = min(words, len(tokens))
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    begins, ends = begins[: len(tokens) - words + 1], ends[words - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), STRIDE):
        spans = zip(begins[at : at + STRIDE].tolist(), ends[at : at + STRIDE].tolist())
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64)
        for part in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[part : part + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "print"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print) of every row; whole texts, null counts as empty."""
    return texts(docs).mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, print long")


class BKTree:
    """A Burkhard-Keller tree over distinct 64-bit numbers in flat arrays.

    Children of a node are keyed by their Hamming distance to it. All nodes of a level are placed
    together: points follow the edge of their distance until one opens an edge of its own.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        self.child = np.full((n, BITS + 1), -1, np.int32)
        rest, node = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(rest):
            edge = np.bitwise_count(points[rest] ^ points[node]).astype(np.int64)
            slot, first = np.unique(node * (BITS + 1) + edge, return_index=True)
            open_ = self.child.reshape(-1)[slot] < 0
            self.child.reshape(-1)[slot[open_]] = rest[first[open_]]
            node = self.child[node, edge].astype(np.int64)
            going = node != rest
            rest, node = rest[going], node[going]

    def within(self, probes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, node) places at a distance of at most radius, level by level; only edges whose
        key differs from the probe's distance by at most the radius are followed."""
        probe, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        while len(probe) and len(self.points):
            far = np.bitwise_count(probes[probe] ^ self.points[node]).astype(np.int64)
            near = far <= radius
            yield probe[near], node[near]
            edges = far[:, None] + np.arange(-radius, radius + 1)
            inside = (edges >= 0) & (edges <= BITS)
            below = np.where(inside, self.child[node[:, None], np.clip(edges, 0, BITS)], -1)
            row, col = np.nonzero(below >= 0)
            probe, node = probe[row], below[row, col].astype(np.int64)


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
    while (root != root[root]).any():
        root = root[root]
    return root


def _unit_links(tree: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a shard tree and a block of probes have in common, one for each print that is not a root."""
    both, place = np.unique(np.concatenate([tree, probes]), return_inverse=True)
    of_tree, of_probes = place[: len(tree)], place[len(tree) :]
    index = BKTree(tree)

    def pairs():
        for at in range(0, len(probes), 256):
            for p, n in index.within(probes[at : at + 256], radius):
                yield of_probes[at + p], of_tree[n]

    root = _roots(len(both), pairs())
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[linked], both[root[linked]]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task come ordered by unit; each unit is searched as soon as it is whole."""
    held: list[np.ndarray] = []
    last = None

    def unit() -> pa.RecordBatch:
        rows = np.concatenate(held)
        tree, probes = rows[rows[:, 3] == rows[:, 1]][:, 4], rows[rows[:, 3] == rows[:, 2]][:, 4]
        a, b = _unit_links(tree.view(np.uint64), probes.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], 1)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
        for part in np.split(rows, cuts):
            if last is not None and (part[0, :3] != last).any():
                yield unit()
                held = []
            held.append(part)
            last = part[0, :3]
    if held:
        yield unit()


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct prints at most ``radius`` bits apart, enough to connect all of them.

    With radius + 1 bands of bits, two such prints agree in a band. A shard holds the prints whose
    value of one band falls in a bucket; buckets are as many as keep shards at a couple of thousand
    prints. A larger shard (many prints that agree in a band) is cut into several trees, and each
    tree is sent to every block of the shard's probes, so no task holds more than one tree and one
    block. Of a pair of tree and block only the links of a spanning forest come back.
    """
    n = prints.count()
    bands, width = radius + 1, -(-BITS // (radius + 1))
    buckets = max(1, n // SHARD)
    # the band number and a bucket of its value, in one long
    band = lambda i: F.expr(f"shiftrightunsigned(print, {i * width}) & {(1 << width) - 1}L")
    keys = F.array(*[F.lit(i * buckets) + F.pmod(F.xxhash64(band(i)), F.lit(buckets)) for i in range(bands)])
    rows = prints.select("print", F.explode(keys).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"))
    parts = sizes.select("shard", F.greatest(F.lit(1), (F.col("n") / (2 * SHARD)).cast("long")).alias("parts"))
    rows = rows.join(parts, "shard").withColumn("own", F.pmod(F.xxhash64("print", F.lit(7)), F.col("parts")))
    rows = rows.select("shard", "own", "print", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = rows.select("shard", low.alias("tree"), high.alias("block"), "own", "print")
    dealt = units.repartition("shard", "tree", "block").sortWithinPartitions("shard", "tree", "block")
    return dealt.mapInArrow(lambda it: _search(it, radius), "a long, b long")


def hex_print(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, print, component_id) of every row; component_id is the smallest doc_id of the group.

    Rows whose SimHashes differ in at most ``radius`` bits are linked; groups are what links
    connect. Texts without words (empty, null, white space) have print 0 and are linked like any
    other. Equal prints are one node from the start, so exact copies never meet as pairs. Rows
    with a null or repeated doc_id keep their rows; nulls don't count for the smallest id. An
    empty table gives no rows.
    """
    rows = settle(fingerprints(docs, words), "prints")
    nodes = settle(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "print-nodes")
    found = components(links(nodes.select("print"), radius), "print-groups")
    named = nodes.join(found, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = settle(named.join(least, "component").select("print", "component_id"), "print-ids")
    return rows.join(groups, "print").select("doc_id", "print", "component_id")


# Similar documents: SimHash candidates at a wide radius inside shards of documents that share a min-hash, each
# verified by the similarity of whole shingle sets. What these miss, a prefix join finds between the groups so far.

#: Min-hashes of a document, each a shard.
SHARDS = 6
#: Bits by which SimHashes of distinct shingles may differ in the shards; the prefix join needs no radius.
WIDE = 20
_ROW = "doc_id long, t1 long, t2 long, size long, shards array<long>"
#: One shared shingle more is asked of longer prefixes for so many shingles of a set.
MORE = 20


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles, in 64 bits."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words = min(words, len(tokens))
    shingles = {b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} if tokens else set()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def set_print(hashes: np.ndarray) -> int:
    """SimHash of a shingle set, each shingle once, so that it estimates the similarity of sets."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def prefix_size(n: int, similarity: float) -> int:
    """So many first shingles, in any order that all sets share, of which similar sets have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    odd = [np.uint64(int(m) * 2 + 1) for m in np.random.default_rng(4).integers(1, 2**62, SHARDS)]
    for batch in batches:
        sizes, shards = [], []
        for text in batch.column(3).to_pylist():
            x = shingle_set(text, words)
            sizes.append(len(x))
            shards.append([int((x * m >> np.uint64(20)).min()) * SHARDS + i if len(x) else i for i, m in enumerate(odd)])
        columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(shards, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROW.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, print, shingles) of texts, copies in a batch once."""
    for batch in batches:
        nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        found = batch.column(1).take(pa.array(first)).to_pylist()
        sets = [shingle_set(t, words) for t in found]
        columns = [pa.array(nodes), pa.array(map(set_print, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "print", "shingles"])


def _least(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, t1): the prefix of each text's shingles in order of their hashes, copies in a batch once.

    Prefixes that are k longer than ``prefix_size`` have k shingles more in common.
    """
    for batch in batches:
        marks, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        for mark, text in zip(marks.tolist(), batch.column(1).take(pa.array(first)).to_pylist()):
            x = shingle_set(text, words)
            x = x[: prefix_size(len(x), similarity) + max(1, len(x) // MORE) - 1].view(np.int64)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), mark))], ["key", "t1"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, group): every shingle of each set."""
    for batch in batches:
        for node, group, raw in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(raw, np.int64)
            columns = [x, np.full(len(x), node, np.int64), np.full(len(x), group, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "group"])


def _similar(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (shard, tree, block); each unit is searched and verified when it is whole."""
    held: list[tuple] = []
    last = None

    def unit() -> pa.RecordBatch:
        low, high = last[1:]
        nodes = {r[1]: r for r in held}  # node: (own, node, print, shingles)
        ids = sorted(nodes)
        own = np.array([nodes[i][0] for i in ids])
        prints = np.array([nodes[i][2] for i in ids], np.int64).view(np.uint64)
        sets = [np.frombuffer(nodes[i][3], np.uint64) for i in ids]
        size = np.array([len(s) for s in sets])
        every = np.unique(np.concatenate(sets)) if size.any() else np.zeros(0, np.uint64)
        local = [np.searchsorted(every, s) for s in sets]
        in_tree, probes = np.flatnonzero(own == low), np.flatnonzero(own == high)
        distinct, place = np.unique(prints[in_tree], return_inverse=True)
        members = np.split(in_tree[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place, minlength=len(distinct)))[:-1])
        root, tree, mark = np.arange(len(ids)), BKTree(distinct), np.zeros(len(every), bool)
        for p in probes if len(distinct) else ():
            near = [members[n] for _, found in tree.within(prints[p : p + 1], radius) for n in found]
            others = np.concatenate(near) if near else np.zeros(0, np.int64)
            others = others[(others != p) & (root[others] != root[p])]
            # the smaller set can't be too small
            others = others[np.minimum(size[others], size[p]) >= similarity * np.maximum(size[others], size[p])]
            if not len(others):
                continue
            mark[local[p]] = True
            hits = np.append(0, np.cumsum(mark[np.concatenate([local[o] for o in others])]))
            common = np.diff(hits[np.append(0, np.cumsum(size[others]))])
            mark[local[p]] = False
            union = size[others] + size[p] - common
            for r in np.unique(root[others[common >= similarity * union]]):
                a, b = min(r, root[p]), max(r, root[p])
                root[root == b] = a
        linked = np.flatnonzero(root != np.arange(len(ids)))
        nodes_ = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes_[linked]), pa.array(nodes_[root[linked]])], ["a", "b"])

    for batch in batches:
        for shard, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (shard, low, high) != last:
                yield unit()
                held = []
            last = (shard, low, high)
            held.append(tuple(row))
    if held:
        yield unit()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, t1, t2, group) of every row: groups of documents linked by the similarity of their word shingles.

    Two texts are linked if their sets of ``words``-word shingles (lowered A-Z, split at ASCII
    white space; a shorter text is one shingle) have a Jaccard similarity of at least
    ``similarity``. Candidates are first texts that share one of six min-hashes and whose SimHashes
    a BK-tree finds within a wide radius, then, between the groups that these links give, all texts
    that share a shingle of their prefixes; such a join of similar sets loses no pair. Texts without words are all alike. t1 and t2 are a 128-bit key of the text; equal texts are
    one node, so copies never meet as pairs. Large shards are cut into trees and blocks of probes.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = texts(docs).select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(9), text).alias("t2"), text.alias("text"))
    rows = settle(keyed.mapInArrow(lambda it: _shingled(it, words), _ROW), "similar-rows")
    distinct = rows.select("t1", "t2", "size").distinct()
    node = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    shards = rows.join(node, ["t1", "t2"]).select("node", F.explode("shards").alias("shard")).distinct()
    shared = settle(_parts(shards), "similar-shards")
    meeting = settle(_meeting(keyed.select("t1", "text"), node, words, similarity), "similar-meeting")
    # whole shingle sets only of texts that share a shard or a shingle of their prefixes
    wanted = node.join(shared.select("node").union(meeting.select("node")).distinct(), "node", "left_semi")
    sets = keyed.join(wanted, ["t1", "t2"]).select("node", "text")
    sets = sets.mapInArrow(lambda it: _sets(it, words), "node long, print long, shingles binary")
    sets = settle(sets, "similar-sets")  # copies may repeat
    found = settle(_unit_similar(shared, sets, WIDE, similarity), "similar-links")
    groups = components(found, "similar-groups").withColumnsRenamed({"node": "_node", "component": "_group"})
    grouped = settle(node.join(groups, F.col("node") == F.col("_node"), "left").select("node", "size", F.coalesce("_group", "node").alias("group")), "similar-grouped")
    rest = settle(_parts(_prefixes(meeting, grouped, sets, similarity)), "similar-prefixes")
    more = settle(_unit_similar(rest, sets, BITS, similarity), "similar-rest")
    groups = components(found.union(more), "similar-all").withColumnsRenamed({"node": "_node", "component": "_group"})
    named = node.join(groups, F.col("node") == F.col("_node"), "left").select("t1", "t2", F.coalesce("_group", "node").alias("group"))
    return rows.select("doc_id", "t1", "t2").join(named, ["t1", "t2"]).select("doc_id", "t1", "t2", "group")


def _parts(shards: DataFrame) -> DataFrame:
    """(shard, node, parts) of shards with several nodes; a large one is cut into parts."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("shard", F.greatest(F.lit(1), (F.col("n") / SHARD).cast("long")).alias("parts"))
    return shards.join(parts, "shard").select("shard", "node", "parts")


def _unit_similar(shared: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of verified pairs, shard by shard; those of a cut shard in units of two parts."""
    cut = shared.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
    cut = cut.select("shard", "own", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = cut.select("shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("block"), "own", "node")
    here = sets.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    units = units.join(here, "node").select("shard", "tree", "block", "own", "node", "print", "shingles")
    dealt = units.repartition("shard", "tree", "block").sortWithinPartitions("shard", "tree", "block")
    return dealt.mapInArrow(lambda it: _similar(it, radius, similarity), "a long, b long")


def _meeting(texts_: DataFrame, node: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node) of shingles that stand in the prefixes, by hash, of different texts; nodes with enough of them."""
    least = settle(texts_.mapInArrow(lambda it: _least(it, words, similarity), "key long, t1 long"), "similar-least")
    bounds = least.groupBy("key").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo <> hi").select("key")
    met = settle(least.join(bounds, "key").distinct().join(node, "t1").select("key", "node", "size"), "similar-met")
    return met.join(_enough(met, similarity, "node", "size"), "node", "left_semi").select("key", "node")


def _enough(met: DataFrame, similarity: float, *by: str) -> DataFrame:
    """Nodes that share as many shingles of their prefixes as they must with any similar text, which may be the smaller."""
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * similarity - 1e-9) / MORE))
    return met.groupBy(*by).agg(F.count("*").alias("met")).where(F.col("met") >= need).drop("met")


def _prefixes(meeting: DataFrame, grouped: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shard, node): shingles by which similar texts of different groups meet.

    Texts that meet one of another group in the order of hashes are ordered anew: shingles of one group
    alone come first, which can't be shared with another, and the rarest of the others next. Of
    shingles that stand in the prefixes of the same texts one is enough.
    """
    several = F.min("group") != F.max("group")
    here = meeting.join(grouped, "node")
    keys = here.groupBy("key").agg(several.alias("several")).where("several").select("key")
    some = settle(_enough(here.join(keys, "key"), similarity, "node", "group", "size"), "similar-some")
    own = settle(sets.join(some, "node").dropDuplicates(["node"]).select("node", "group", "shingles"), "similar-own")
    members = own.mapInArrow(_members, "key long, node long, group long")
    counts = members.groupBy("key").agg(several.alias("several"), F.count("*").alias("n")).where("several").select("key", "n")
    met = settle(members.join(counts, "key"), "similar-common")
    # shingles of one group alone fill a prefix first
    alone = met.groupBy("node").agg(F.count("*").alias("common")).join(some.select("node", "size"), "node")
    prefix = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    room = alone.select("node", (prefix - F.col("size") + F.col("common")).alias("room")).where("room > 0")
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "key"))
    met = met.join(room, "node").withColumn("place", place).where("place <= room")
    met = settle(met.select(F.col("key").alias("shard"), "node", "group"), "similar-first")
    code = F.xxhash64("node", F.lit(11))
    alike = met.groupBy("shard").agg(several.alias("several"), F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(code).alias("y"))
    one = alike.where("several").groupBy("n", "x", "y").agg(F.min("shard").alias("shard")).select("shard")
    return met.join(one, "shard").select("shard", "node")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar documents: the one with the smallest doc_id, all columns kept.

    Null ids come last. Of rows with that doc_id the one with the smallest text key stays; rows that
    repeat both doc_id and text are one document, of which one row stays.
    """
    groups = similar_documents(docs, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    first = groups.groupBy("group").agg(F.min(order).alias("f")).select("f.doc_id", "f.t1", "f.t2")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # no name of the table meets one used here
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keys = {"id": F.col("row.doc_id").cast("long"), "a": F.xxhash64(text), "b": F.xxhash64(F.lit(9), text)}
    here = docs.select(row.alias("row")).withColumns(keys)
    match = F.col("a").eqNullSafe(F.col("t1")) & F.col("b").eqNullSafe(F.col("t2")) & F.col("id").eqNullSafe(F.col("doc_id"))
    kept = here.join(first, match, "left_semi").dropDuplicates(["a", "b", "id"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
