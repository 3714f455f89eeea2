"""Operator 8: token ids in binary files of Simple-8b words, and reading them back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityflow.llm import chunks, simple8b
from cityflow.llm.common import parts_for, settle, texts
from cityflow.session import scratch

#: Bytes of text that go to one file, and ids that go to one frame of it.
FILE_BYTES = 32 * 1024**2
FRAME_IDS = 1 << 18

# A file is a row of frames. A frame: this header, doc ids, whether a doc id is there, ids of each
# document, word offset of each block, words, escaped values. Numbers are little-endian; one byte,
# a line feed that Spark's writer puts there, ends a frame.
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIIQQQ")


def pack_frame(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    words, offsets, escaped = simple8b.encode(flat)
    return b"".join(
        [
            HEADER.pack(MAGIC, len(keys), len(offsets), len(flat), len(words), len(escaped)),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is not None for k in keys], "u1").tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escaped.astype("<u8").tobytes(),
        ]
    )


def unpack_frames(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids of each document, all ids) of each frame of a file."""
    at = 0
    while at < len(content):
        magic, docs, blocks, n, n_words, n_escaped = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at += HEADER.size
        fields = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks), ("<u8", n_words), ("<u8", n_escaped)):
            fields.append(np.frombuffer(content, kind, count, at))
            at += fields[-1].nbytes
        keys, there, counts, offsets, words, escaped = fields
        at += 1
        yield [int(k) if t else None for k, t in zip(keys, there)], counts, simple8b.decode(words, offsets, escaped, n)


def _frames(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    keys, ids, held = [], [], 0
    frame = lambda: pa.RecordBatch.from_arrays([pa.array([pack_frame(keys, ids)], pa.binary())], ["frame"])
    for batch in batches:
        own, words = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in chunks.strides(words):
            for key, found in zip(own[part], chunks.word_table(tokenizer).texts(words[part])):
                keys.append(key)
                ids.append(np.append(found, end_id).astype(np.uint64))
                held += len(ids[-1])
                if held >= FRAME_IDS:
                    yield frame()
                    keys, ids, held = [], [], 0
    if keys:
        yield frame()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode whole texts (null: empty), append the end id, and write files of ids in doc_id order.

    Files follow each other in the order of the numbers in their names. Documents are dealt by ranges of
    (doc_id, hash of the text), so that a repeated id can be split too; a null id comes first,
    equal ids are ordered by text, repeated rows are kept, other columns are ignored. The files
    are written and committed by Spark's own writer, to any store that Spark can write to.
    An empty table makes no file with rows.
    """
    rows = texts(docs).withColumn("_mark", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(parts_for(rows, size, FILE_BYTES), "doc_id", "_mark")
    frames = (
        dealt.sortWithinPartitions("doc_id", "_mark", "text")
        .select("doc_id", "text")
        .mapInArrow(lambda it: _frames(it, tokenizer, end_id), "frame binary")
    )
    frames.select(F.col("frame").cast("string")).write.text(path)


def _read(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            start = 0
            for keys, counts, flat in unpack_frames(content.as_py()):
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts.astype(np.int64)
                flat = flat.astype("<u4") if digest else flat.astype(np.int64)
                if digest:
                    value = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(starts, ends)], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
                columns = [
                    pa.array([name.as_py()] * len(keys), pa.string()),
                    pa.array(keys, pa.int64()),
                    pa.array(starts + start, pa.int64()),
                    pa.array(counts.astype(np.int64)),
                    value,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "at", "n_tokens", "value"])
                start += int(ends[-1])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(file, doc_id, at, n_tokens, value) of every document in the files.

    ``at`` counts the ids before the document in its file; ``value`` holds the ids, or with
    ``digest`` the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    kind = "long" if digest else "array<long>"
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(name, "content").mapInArrow(
        lambda it: _read(it, digest), f"file string, doc_id long, at long, n_tokens long, value {kind}"
    )


def file_number(name: str = "file") -> Column:
    """The number that Spark's writer gives a part: its name as text puts part-100000 before part-99999."""
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def token_file_rows(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files and read them back: (doc_id, start, n_tokens, ids_crc32) of every document.

    Starts are sums over the files before; that window runs over one row per file.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    rows = settle(read_token_files(spark, path, digest=True), "token-rows")
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(file_number()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", before.alias("_before"))
    return rows.join(starts, "file").select(
        "doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32")
    )
