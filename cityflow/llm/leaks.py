"""Operator 13: benchmark passages in documents, by one Aho-Corasick automaton over words."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.llm.common import discard, settle, ship, unused

#: Consecutive words of an item that give it away.
WINDOW = 10
#: Windows of a piece of an item, and bytes of the pieces of one automaton (a worker holds some hundred times as many);
#: more pieces take more passes.
PIECE, BLOCK_BYTES = 1024, 1 << 20

#: Bytes of a text as they are compared: A-Z lower-cased, what is no part of a word a space. All bytes of
#: code points beyond ASCII belong to words, so words can be cut from bytes.
_SPOKEN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPOKEN).split()


def word_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (begin, end) of ranges of words, in the text as it was."""
    raw = np.frombuffer(text, np.uint8)
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    at = np.array([m.span() for m in _WORD.finditer(text.translate(_SPOKEN))])
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in ranges]


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order of their ends, made apart: those that meet or touch become one."""
    out: list[tuple[int, int]] = []
    for begin, end in ranges:
        while out and out[-1][1] >= begin:
            begin = min(begin, out.pop()[0])
        out.append((begin, end))
    return out


class Windows:
    """All windows of some items in one automaton over numbers of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            found = tuple([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)])
            for at in range(max(1, len(found) - size + 1) if found else 0):
                owners.setdefault(found[at : at + size], []).extend([] if item is None else [item])
        self.owners = list(owners.values())
        self.shortest = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, window in enumerate(owners):
            self.automaton.add_word(window, (i, len(window)))
        if owners:
            self.automaton.make_automaton()

    def found(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """How many words the text has, the ranges of them that windows cover, and the items of these windows.

        A word of no item ends all matches, so the automaton runs over the stretches between such words.
        """
        spoken = words_of(text)
        known = np.array(list(map(self.number.get, spoken, itertools.repeat(0))), np.int64)
        gaps = np.flatnonzero(np.concatenate(([0], known, [0])) == 0) - 1
        ranges, seen = [], set()
        for i in np.flatnonzero(np.diff(gaps) > self.shortest) if self.owners else ():
            begin, stop = int(gaps[i]) + 1, int(gaps[i + 1])
            for end, (window, length) in self.automaton.iter(tuple(known[begin:stop].tolist())):
                seen.add(window)
                ranges.append((begin + end + 1 - length, begin + end + 1))
        return len(spoken), joined(ranges), {item for window in seen for item in self.owners[window]}


_latest: list[tuple[tuple, Windows]] = []


def _windows(block: Broadcast, size: int) -> Windows:
    """Built once by each worker for a block; the one before is dropped."""
    key = (block.value[0], size)
    if not _latest or _latest[0][0] != key:
        _latest.clear()
        _latest.append((key, Windows(block.value[1], size)))
    return _latest[0][1]


_RANGES = "array<struct<begin:int,end:int>>"
_ADDED = ("n_words", "n_hit", "items", "spans")


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _pairs(values: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    return _lists([[{"begin": a, "end": b} for a, b in row] for row in values], kind)


def _report(batch: pa.RecordBatch, at: int, found: list[tuple], carried: int) -> pa.RecordBatch:
    """The first columns of the batch and (n_words, n_hit, items, spans) of each row."""
    spans = [word_spans(t, r) if r else [] for t, (_, r, _) in zip(_texts(batch.column(at)), found)]
    added = [
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array([sum(b - a for a, b in r) for _, r, _ in found], pa.int64()),
        _lists([sorted(items) for _, _, items in found], pa.string()),
        _pairs(spans),
    ]
    return pa.RecordBatch.from_arrays(batch.columns[:carried] + added, [*batch.schema.names[:carried], *_ADDED])


def _scanned(batches: Iterator[pa.RecordBatch], at: int, block: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    windows = _windows(block, size)
    for batch in batches:
        yield _report(batch, at, [windows.found(t) for t in _texts(batch.column(at))], batch.num_columns)


def _partly(batches: Iterator[pa.RecordBatch], block: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    """(row, ranges, items) of the rows of (row, text) with a hit."""
    windows = _windows(block, size)
    for batch in batches:
        found = [windows.found(t) for t in _texts(batch.column(1))]
        some = [i for i, (_, ranges, _) in enumerate(found) if ranges]
        columns = [
            batch.column(0).take(pa.array(some, pa.int64())),
            _pairs([found[i][1] for i in some]),
            _lists([sorted(found[i][2]) for i in some], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "ranges", "items"])


def _merged(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows with what all passes have found in them, in the last two columns."""
    for batch in batches:
        ranges, items = (c.to_pylist() for c in batch.columns[-2:])
        apart = [joined(sorted(((x["begin"], x["end"]) for x in r or []), key=lambda x: x[::-1])) for r in ranges]
        counts = [len(words_of(t)) for t in _texts(batch.column(at))]
        found = [(n, r, set(i or [])) for n, r, i in zip(counts, apart, items)]
        yield _report(batch, at, found, batch.num_columns - 2)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(item, piece): normalised words of items, long ones in pieces that share size - 1 words."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            spoken = words_of(text)
            for at in range(0, max(1, len(spoken) - size + 1) if spoken else 0, PIECE):
                rows.append((item, b" ".join(spoken[at : at + PIECE + size - 1]).decode()))
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "piece"])


def _blocks(items: DataFrame, size: int, block_bytes: int) -> Iterator[Broadcast]:
    """The items' pieces, broadcast in blocks whose size has been summed up; one block without pieces if there are none."""
    ship(items.sparkSession)
    cut = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    pieces = cut.mapInArrow(lambda it: _pieces(it, size), "item string, piece string").distinct()
    pieces = settle(pieces.withColumn("bytes", F.octet_length("piece")), "benchmark-pieces")
    total, number = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // block_bytes))
    dealt = lambda n: F.pmod(F.xxhash64("item", "piece"), F.lit(n))
    while 1 < n < number:
        if pieces.groupBy(dealt(n)).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= 2 * block_bytes:
            break
        n *= 2
    for i in range(n):
        rows = [(r.item, r.piece.encode()) for r in pieces.where(dealt(n) == i).collect()]
        if rows or n == 1:
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    discard(pieces)


def marked(
    docs: DataFrame,
    items: DataFrame,
    added: tuple[str, str, str, str],
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with four added columns: how many words the text has, how many of them are hit, the ids of the
    items found (as strings, sorted, each once), and the code points (begin, end) of the text where hit words stand.

    Words are compared with A-Z in lower case; everything between them counts as one space. A document word is hit if it
    belongs to an occurrence of ``size`` consecutive words of an item, or of all words of an item of (item_id, text) that has
    fewer. Null and empty texts have no words, nor have items with such texts; an item with a null id hits, but is not
    listed; items of equal id are one. Hits that meet or touch are one span. All rows and columns are kept; an empty table
    gives no rows, and without items nothing is hit.

    The items make one automaton as long as their words fit ``block_bytes``; each text is then scanned once, where it is
    read. More items make several automata: documents are written once with row numbers, each automaton scans all of them, and
    hits are put together by row.
    """
    ship(docs.sparkSession)
    at, outer = docs.columns.index("text"), [*docs.columns, *added]
    docs = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of the table meets one used here
    spans = T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer"))
    kinds = T.StructType([*docs.schema.fields])
    for name, kind in zip(_ADDED, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), spans)):
        kinds.add(name, kind)
    blocks = list(_blocks(items, size, block_bytes))
    if len(blocks) == 1:
        return docs.mapInArrow(lambda it: _scanned(it, at, blocks[0], size), kinds).toDF(*outer)
    rows = settle(docs.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    texts = rows.select("row", F.col(f"c{at}").cast("string"))
    hits = None
    for block in blocks:
        some = texts.mapInArrow(lambda it, b=block: _partly(it, b, size), f"row long, ranges {_RANGES}, items array<string>")
        hits = hits.union(some) if hits else some
    hits = hits.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "items")])
    whole = rows.join(hits, "row", "left").select(*docs.columns, "ranges", "items")
    return whole.mapInArrow(lambda it: _merged(it, at), kinds).toDF(*outer)


def without_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, as they are."""
    added = unused(docs, "n_words", "n_hit", "items", "spans")
    return marked(docs, items, added, size).where(F.col(added[1]) == 0).drop(*added)


def leak_digests(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = marked(docs.select("doc_id", "text"), items, ("n_words", "n_hit", "items", "spans"), size)
    return found.select(
        F.col("doc_id").cast("long"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
