"""Operator 5: repeated passages by longest-previous-factor arrays over suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.llm.chunks import strides
from cityflow.llm.common import settle, texts
from cityflow.llm.rolling import Rolling

#: Bytes of a repeated passage, and of an anchor inside it.
LENGTH, ANCHOR = 400, 128
#: Starts whose anchors are found at once, and symbols of one suffix array.
BLOCK_BITS = 20
SHARD = 1 << 20
#: An anchor with more different surroundings than this is compared window by window instead.
SURROUNDINGS = 1500

_KEYS = "anchor long, ctx long"
_OCCURRENCE = f"{_KEYS}, t1 long, t2 long, at long, off int, run int"


def _anchored(data: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share an anchor: (anchor hash, hash of the run's bytes, first start, anchor offset, starts).

    ``room`` says whether a whole window begins at a place. Of the hashes of all stretches of ANCHOR
    bytes inside a window the least one is its anchor, the first of equal ones: equal windows have
    equal anchors at equal offsets.
    """
    first = Rolling(data, 0)
    n = len(data) - ANCHOR + 1
    hashes = first.of(slice(0, n), slice(ANCHOR, ANCHOR + n))
    low = np.uint64((1 << BLOCK_BITS) - 1)
    least = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    width, have = length - ANCHOR + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    starts = np.flatnonzero(room[: len(least)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    run = np.diff(np.append(new, len(starts)))
    begin, at = starts[new], anchor[new]
    around = Rolling(data, 1).of(begin, begin + run - 1 + length) ^ ((at - begin) * 65536 + run).astype(np.uint64)
    return hashes[at].view(np.int64), around.view(np.int64), begin, at - begin, run


def _occurrences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OCCURRENCE.split(", ")]
    step = (1 << BLOCK_BITS) - length
    for batch in batches:
        t1, t2, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        once = np.unique(np.stack([t1, t2]), axis=1, return_index=True)[1]  # copies have the same places
        t1, t2, words = t1[once], t2[once], words.take(pa.array(once)).to_pylist()
        for part in strides(words, step // 2):
            raw = [w.encode("utf-8", "surrogatepass") for w in words[part]]
            size = np.array([len(r) for r in raw])
            data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
            owner = np.repeat(np.arange(len(raw)), size)
            room = np.arange(len(data)) + length <= ends[owner]
            for begin in range(0, len(data), step):  # a long text is read in blocks that overlap by a window
                block = data[begin : begin + step + length - 1]
                if len(block) < length:
                    break
                anchor, ctx, at, off, run = _anchored(block, room[begin : begin + step], length)
                at = at + begin
                own = owner[at]
                columns = [anchor, ctx, t1[part][own], t2[part][own], at - (ends - size)[own], off.astype(np.int32), run.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of 16-bit symbols from 1 on, ordered by at least ``depth`` of them, and common prefixes of neighbours (up to that).

    Ranks of prefixes are doubled from 4 symbols on, and only suffixes that are still alike are
    sorted again; the ranks of each length then give the common prefix of two neighbours from long
    to short. It is read only where the symbols before the two differ: elsewhere it is one less
    than that of the position before. Where suffixes stay alike their order is open, so neither
    they nor those behind them go by that.
    """
    n = len(symbols)
    padded = np.append(symbols.astype(np.uint64), np.zeros(4, np.uint64))
    key = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
    order = np.argsort(key)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])  # of those alike
    alike = lambda: ~(first & np.append(first[1:], True))
    ranks, same, reach = [], np.full(n, -1, np.int8), 4  # same: the last level at which a place is like the one before
    while True:
        rank = np.zeros(n + 1, np.int32)  # takes beyond the end are clipped to the 0 there
        rank[order] = np.cumsum(first, dtype=np.int32)
        ranks.append(rank)
        same += ~first
        if reach >= depth or first.all():
            break
        places = np.flatnonzero(alike())
        at = order.take(places)
        key = rank.take(at).astype(np.int64) << 32 | rank.take(at + reach, mode="clip")
        by = np.argsort(key)
        order[places], key = at.take(by), key.take(by)
        first[places[1:]] |= key[1:] != key[:-1]
        reach *= 2
    top = len(ranks) - 1
    behind = np.zeros(n + 1, bool)
    behind[order + 1] = alike()
    before = np.append(np.uint16(0), symbols).take(order)
    read = behind.take(order) | np.append(False, before[1:] != before[:-1])
    read &= same < top
    read[0] = False
    at = np.flatnonzero(read)
    a, b, level_of = order.take(at - 1), order.take(at), same.take(at)
    common = np.zeros(len(at), np.int64)
    for level in range(top - 1, -1, -1):
        common[level_of == level] = 4 << level
        more = np.flatnonzero(level_of > level)
        rank, have = ranks[level], common.take(more)
        x, y = rank.take(a.take(more) + have, mode="clip"), rank.take(b.take(more) + have, mode="clip")
        common[more] = have + ((x == y) & (x > 0)) * (4 << level)
    padded = padded[: n + 1]
    for _ in range(3):
        x, y = padded.take(a + common, mode="clip"), padded.take(b + common, mode="clip")
        common += (x == y) & (x > 0)
    # the common prefix of a position ends where that of the last known one before it ends
    ends, known, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), order[same == top]
    ends[whole], known[whole] = whole + (4 << top), whole
    ends[b], known[b] = b + common, b
    found = ends.take(np.maximum.accumulate(known)).take(order) - order
    found[0] = 0
    return order, found


def _towards(order: np.ndarray, common: np.ndarray, smaller: bool) -> np.ndarray:
    """For each place of the suffix order, the longest prefix shared with the nearest place before it that holds
    a smaller (or larger) position. All places jump together: what a place skips, those behind it skip too."""
    n = len(order)
    value = order if smaller else -order
    near, shared = np.arange(n) - 1, common.copy()
    going = np.flatnonzero(near >= 0)
    mine, to = value.take(going), near.take(going)
    while len(going):
        left = np.flatnonzero(value.take(to) > mine)
        going, mine, to = going.take(left), mine.take(left), to.take(left)
        shared[going] = np.minimum(shared.take(going), shared.take(to))
        near[going] = to = near.take(to)
        left = np.flatnonzero(to >= 0)
        going, mine, to = going.take(left), mine.take(left), to.take(left)
    return np.where(near >= 0, shared, 0)


def factors(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of every position, from suffix order.

    The previous smaller and next smaller positions of a suffix in suffix order are the earlier
    positions that share most with it, so the larger of the two common prefixes is the longest
    previous factor; larger positions give the longest next factor. Lengths from ``depth`` on are
    only known to be at least that.
    """
    order, common = (x.astype(np.int32) for x in suffix_order(symbols, depth))
    back, back_common = np.ascontiguousarray(order[::-1]), np.append(np.int32(0), common[1:][::-1])
    out = []
    for smaller in (True, False):
        best = np.maximum(_towards(order, common, smaller), _towards(back, back_common, smaller)[::-1])
        found = np.empty(len(order), np.int64)
        found[order] = best
        out.append(found)
    return out[0], out[1]


def _intervals(flags: np.ndarray) -> list[int]:
    """Begins and ends of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task come ordered by anchor. Whole anchors are gathered to a shard's size, and each shard gets a suffix array."""
    held: list[tuple] = []
    size = 0
    last = None

    def shard() -> pa.RecordBatch:
        parts, begins, at = [], [], 0
        for i, (_, _, _, data) in enumerate(held):  # a separator of its own ends each stretch
            parts += [np.frombuffer(data, np.uint8).astype(np.uint16) + 1, np.array([257 + i], np.uint16)]
            begins.append(at)
            at += len(data) + 1
        previous, following = factors(np.concatenate(parts), length)
        repeated = np.maximum(previous, following) >= length
        found = [_intervals(repeated[b : b + run]) for b, (_, _, run, _) in zip(begins, held)]
        keys = [pa.array([h[i] for h in held], pa.int64()) for i in (0, 1)]
        columns = [*keys, pa.array(found, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "ctx", "starts"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and size >= SHARD:
                yield shard()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield shard()


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, ctx, run, hot, data) of wanted stretches of each text."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for word, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            raw = word.encode("utf-8", "surrogatepass")
            for w in wanted:
                out.append((w["anchor"], w["ctx"], w["run"], w["hot"], raw[w["at"] : w["at"] + w["run"] - 1 + length]))
                held += len(out[-1][4])
            if held > SHARD:
                yield _stretch_batch(out)
                out, held = [], 0
        if out:
            yield _stretch_batch(out)


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "ctx", "run", "hot", "data"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digests of all windows of stretches whose anchor is too common for one suffix array."""
    for batch in batches:
        for anchor, ctx, run, data in zip(*(c.to_pylist() for c in batch.columns)):
            view = memoryview(data)
            digests = b"".join(hashlib.blake2b(view[i : i + length], digest_size=16).digest() for i in range(run))
            both = np.frombuffer(digests, "<i8").reshape(-1, 2)
            columns = [np.full(run, anchor), np.full(run, ctx), np.arange(run, dtype=np.int32), both[:, 0], both[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["anchor", "ctx", "i", "w1", "w2"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): a 128-bit key of each text; null is empty."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(5), "text"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, whole, spans) of every distinct text with bytes to remove.

    ``whole`` says that the text itself occurs more than once and is at least ``length`` bytes
    long; else ``spans`` lists stretches [from, to) of repeated windows, which may overlap.
    """
    n = F.octet_length("text")
    copies = keyed.where(n >= length).groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = keyed.where(n >= length).select("t1", "t2", "text")
    rows = settle(rows.mapInArrow(lambda it: _occurrences(it, length), _OCCURRENCE), "suffix-anchors")
    place = F.xxhash64("t1", "t2", "at")
    # 1. anchors that occur at more than one place; copies of a text are the same places
    seen = rows.select("anchor", place.alias("p")).groupBy("anchor").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    seen = settle(seen.where("a <> b").select("anchor"), "suffix-seen")
    # both sides are read from files and nothing stands above, so adaptive execution can split the join's hot anchors
    again = settle(rows.join(seen, "anchor", "left_semi"), "suffix-candidates")
    again = settle(again.distinct(), "suffix-repeats")
    # 2. equal surroundings are one class; a class with several places is repeated throughout
    classes = again.groupBy("anchor", "ctx").agg(F.min(place).alias("p"), F.count("*").alias("places"))
    classes = settle(classes, "suffix-classes")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    hot = (F.col("n") > SURROUNDINGS).alias("hot")
    # 3. one stretch of bytes for each class of an anchor with different surroundings
    picked = classes.join(mixed.select("anchor", hot), "anchor").select("anchor", "ctx", "p", "hot")
    stretch = F.struct("anchor", "ctx", "at", "run", "hot")
    wanted = again.withColumn("p", place).join(picked, ["anchor", "ctx", "p"])
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(stretch).alias("wanted"))
    sources = keyed.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("text", "wanted")
    bytes_ = sources.mapInArrow(lambda it: _stretches(it, length), f"{_KEYS}, run int, hot boolean, data binary")
    bytes_ = settle(bytes_, "suffix-stretches")
    # 4. longest previous and next factors inside shards of whole anchors
    cold = bytes_.where("not hot").select("anchor", "ctx", "run", "data").repartition("anchor").sortWithinPartitions("anchor", "ctx")
    found = cold.mapInArrow(lambda it: _shards(it, length), f"{_KEYS}, starts array<int>")
    # the exact way for anchors of very many surroundings: counts of single windows
    single = bytes_.where("hot").select("anchor", "ctx", "run", "data")
    single = settle(single.mapInArrow(lambda it: _windows(it, length), f"{_KEYS}, i int, w1 long, w2 long"), "suffix-windows")
    twice = single.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    more = single.join(twice, ["w1", "w2"], "left_semi").groupBy("anchor", "ctx").agg(F.sort_array(F.collect_list("i")).alias("is"))
    more = more.select("anchor", "ctx", F.flatten(F.transform("is", lambda i: F.array(i, i + 1))).alias("starts"))
    some = settle(found.union(more).where("size(starts) > 0"), "suffix-found")
    # 5. back to every place
    verdicts = classes.join(some, ["anchor", "ctx"], "left").where("places > 1 or starts is not null")
    verdicts = verdicts.select("anchor", "ctx", F.when(F.col("places") <= 1, F.col("starts")).alias("starts"))
    verdicts = settle(verdicts, "suffix-verdicts")  # plain on both sides again: a hot class can be split
    at = again.join(verdicts, ["anchor", "ctx"]).join(copies, ["t1", "t2"], "left_anti")
    starts = F.coalesce("starts", F.array(F.lit(0), F.col("run")))
    pieces = at.select("t1", "t2", "at", F.posexplode(starts).alias("i", "edge"), starts.alias("starts")).where("i % 2 = 0")
    begin, end = F.col("at") + F.col("edge"), F.col("at") + F.get("starts", F.col("i") + 1) - 1 + length
    spans = pieces.groupBy("t1", "t2").agg(F.collect_list(F.struct(begin.alias("begin"), end.alias("end"))).alias("spans"))
    none = F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans")
    whole = copies.select("t1", "t2", F.lit(True).alias("whole"), none)
    return spans.select("t1", "t2", F.lit(False).alias("whole"), "spans").union(whole)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, count, kept = [], [], [], []
        for word, whole, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            raw = word.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = [[0, len(raw)]] if whole else []
            for s in sorted((s["begin"], s["end"]) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            edges = [0, *(e for r in runs for e in r), len(raw)]
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in runs))
            count.append(len(runs))
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, count)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: what is left of each text as bytes.

    Every byte is removed that is covered by a string of ``length`` bytes which also begins
    anywhere else, in the same text or another; strings never cross texts and are judged on the
    input. Exact copies of a text of that length vanish whole. Null and empty texts have nothing
    to remove; repeated rows are copies; other columns are ignored; an empty table gives no rows.

    Each window's anchor, its least inner hash, brings equal windows together without comparing
    texts; only anchors at several places go on, equal surroundings count as one, and shards of
    whole anchors get suffix arrays whose longest previous and next factors find repeats.
    """
    keyed = _keyed(docs)
    found = keyed.join(repeated_spans(keyed, length), ["t1", "t2"], "left").select("doc_id", "text", "whole", "spans")
    return found.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts, a digest of what is left of each text, the text that is left, with U+FFFD where a cut parts a code point, and
    whether anything was removed."""
    rows = remove_repeats(docs, length)
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    repeated = (F.col("n_removed") > 0).alias("repeated")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text, repeated)
