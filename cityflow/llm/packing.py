"""Operator 2: packing by lexical retrieval; a sharded BM25 index fills the window of each seed document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.llm import chunks
from cityflow.llm.common import parts_for, settle, texts

WINDOW = 4096
#: Documents of one index shard at most, and ids of one task.
SHARD_DOCS = 512
TASK_IDS = 8_000_000
# Usual BM25 weights.
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def squeeze(ids: np.ndarray) -> bytes:
    """Ids as zstd-compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def topic_key(terms: np.ndarray) -> int:
    """Two min-hashes of a document's distinct ids, one above the other: like documents sort together."""
    if not len(terms):
        return 0
    mixed = [(terms.astype(np.uint64) + np.uint64(1)) * np.uint64(m) >> np.uint64(33) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return int(mixed[0].min()) << 31 | int(mixed[1].min())


ENCODED = "doc_id long, topic long, n long, ids binary, terms array<int>, df array<long>"


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one more for the task: in how many of its documents each id occurs."""
    table = chunks.word_table(tokenizer)
    total, docs = np.zeros(max(len(table.is_end), end_id + 1), np.int64), 0
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in ENCODED.split(", ")]
    for batch in batches:
        keys, words = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in chunks.strides(words):
            ids = [np.append(x, np.int32(end_id)) for x in table.texts(words[part])]
            terms = [np.unique(x) for x in ids]
            for t in terms:
                total[t] += 1
            none = [None] * len(ids)
            columns = (keys[part], map(topic_key, terms), map(len, ids), map(squeeze, ids), none, none)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
            docs += len(ids)
    if docs:
        some = np.flatnonzero(total)
        columns = ([None], [None], [docs], [None], [some.tolist()], [total[some].tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Shard:
    """An inverted index over a few hundred documents; weights use the whole corpus' statistics."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        counted = [np.unique(x, return_counts=True) for x in ids]
        sizes = np.array([len(t) for t, _ in counted], np.int64)
        term, tf = (np.concatenate([c[i] for c in counted]).astype(np.int64) for i in (0, 1))
        doc = np.repeat(np.arange(len(ids)), sizes)
        length = np.array([len(x) for x in ids], float)[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.terms, self.begin = np.unique(term[order], return_index=True)
        self.size = np.diff(np.append(self.begin, len(order)))
        self.own = [t for t, _ in counted]

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents of the shard, best BM25 score against the seed's ids first; ties by place."""
        at = np.searchsorted(self.terms, self.own[seed])
        size = self.size[at]
        ends = np.cumsum(size)
        rows = np.repeat(self.begin[at] - ends + size, size) + np.arange(ends[-1])
        score = np.bincount(self.doc[rows], self.weight[rows], len(self.own))
        return np.argsort(-score, kind="stable")


class Packer:
    """Fills windows from shard after shard; a window that a shard can't fill is filled from the next."""

    def __init__(self, first_id: int, idf: np.ndarray, mean_length: float):
        self.sequence, self.idf, self.mean_length = first_id, idf, mean_length
        self.open: list[tuple] = []  # pieces of the window being filled
        self.used = 0
        self.rows: list[tuple] = []

    def close(self) -> None:
        at = 0
        for key, ids, start, length in self.open:
            crc = zlib.crc32(ids[start : start + length])
            self.rows.append((key, start, length, crc, len(ids), self.sequence, at))
            at += length
        self.sequence += 1
        self.open, self.used = [], 0

    def put(self, key: int | None, ids: np.ndarray, start: int) -> int:
        """Put what fits of a document's rest into the window; gives the new start."""
        length = min(len(ids) - start, WINDOW - self.used)
        self.open.append((key, ids, start, length))
        self.used += length
        if self.used == WINDOW:
            self.close()
        return start + length

    def shard(self, keys: list, ids: list[np.ndarray]) -> None:
        index, start = Shard(ids, self.idf, self.mean_length), [0] * len(ids)
        unused = np.ones(len(ids), bool)

        def take(i: int) -> None:
            start[i] = self.put(keys[i], ids[i], start[i])
            unused[i] = start[i] < len(ids[i])

        for seed in range(len(ids)):
            while unused[seed] and (self.used or len(ids[seed]) - start[seed] >= WINDOW):
                take(seed)  # finishes an open window, or fills whole ones
            if not unused[seed]:
                continue
            take(seed)
            for i in index.neighbours(seed):
                if not self.used:
                    break
                if unused[i]:
                    take(i)

    def finish(self) -> None:
        """What is left when the task's documents end becomes sequences of powers of two, which need no padding."""
        rest, self.open, used = self.open, [], self.used
        self.used = 0
        size = 1 << max(used, 1).bit_length() - 1
        for key, ids, start, length in rest:
            while length:
                n = min(length, size - self.used)
                self.open.append((key, ids, start, n))
                start, length, self.used, used = start + n, length - n, self.used + n, used - n
                if self.used == size:
                    self.close()
                    size = 1 << max(used, 1).bit_length() - 1

    def drain(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECE.split(", ")]
        columns = zip(*self.rows) if self.rows else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)
        self.rows = []
        return out


def _packed(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean_length: float) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId() << 40, idf, mean_length)
    keys, ids = [], []
    for batch in batches:
        for key, data in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            ids.append(unsqueeze(data.as_py()))
            if len(keys) == SHARD_DOCS:
                packer.shard(keys, ids)
                keys, ids = [], []
                yield packer.drain()
    if keys:
        packer.shard(keys, ids)
    packer.finish()
    yield packer.drain()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids, related documents together.

    Texts (null: empty) are encoded and end with the end id. Documents are dealt in ranges of a
    min-hash key, so that like documents meet; consecutive documents of a task form shards of
    an inverted index. Each seed document in turn asks its shard for neighbours by BM25, whose
    document frequencies and mean length come from all documents, and unused neighbours fill
    its window; the last one is cut to fit and its rest stays unused. Only what is left at the
    end of a task becomes shorter sequences, whose lengths are powers of two. Every id is in
    exactly one piece, repeated rows are documents of their own, a null doc_id stays null, other
    columns are ignored, an empty table gives no rows. A large group of copies shares one key;
    ranges also use the doc_id, so it is split over tasks.

    Broadcast: one float per id of the vocabulary, whose size is fixed.
    """
    spark = docs.sparkSession
    rows = settle(texts(docs).mapInArrow(lambda it: _encoded(it, tokenizer, end_id), ENCODED), "packing-ids")
    encoded = rows.where("ids is not null").select("doc_id", "topic", "n", "ids")
    n_docs, n_ids = encoded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = rows.where("ids is null").select(F.inline(F.arrays_zip("terms", "df")))
    counts = counts.groupBy("terms").agg(F.sum("df").alias("df")).collect()  # at most the vocabulary
    df = np.zeros(max([end_id, *(r.terms for r in counts)]) + 1)
    df[[r.terms for r in counts]] = [r.df for r in counts]
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))
    mean_length = n_ids / max(n_docs, 1)
    dealt = encoded.repartitionByRange(parts_for(encoded, n_ids, TASK_IDS), "topic", "doc_id")
    dealt = dealt.sortWithinPartitions("topic", "doc_id").select("doc_id", "ids")
    return dealt.mapInArrow(lambda it: _packed(it, idf.value, mean_length), PIECE)
