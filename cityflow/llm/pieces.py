"""Operator 1: sentencepiece encoding and decoding over distinct marked words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cityflow.llm import chunks
from cityflow.llm.common import texts

END = 2


def check_model(path: str) -> None:
    """Chunks are independent only if no piece holds a space mark after another character
    and the model neither rewrites nor trims text; other models are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if any("▁" in p.piece.lstrip("▁") for p in model.pieces):
        raise ValueError("a piece crosses a space mark")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError("the model's normaliser changes text across chunks")


def _parts(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[list, list[list[int]], list[str]]]:
    """Keys, ids with the end id, and decoded texts of a few megabytes of text at a time."""
    processor = chunks.piece_processor(model)
    for batch in batches:
        keys, words = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in chunks.strides(words):
            ids = [x.tolist() + [END] for x in chunks.piece_table(model).texts(words[part])]
            yield keys[part], ids, [processor.decode(x) for x in ids]


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for keys, ids, decoded in _parts(batches, model):
        columns = [pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded): exactly what the sentencepiece library gives for every whole text.

    Pieces of such a model never cross a space mark, so each distinct marked word of a batch
    is segmented once and its ids are joined back by position. A null text counts as empty
    (only the end id); repeated rows stay repeated; other columns are ignored; an empty table
    gives no rows. No shuffle: one pass over the table.
    """
    check_model(model)
    return texts(docs).mapInArrow(lambda it: _encoded(it, model), "doc_id long, ids array<int>, decoded string")


def _digests(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for keys, ids, decoded in _parts(batches, model):
        columns = [
            pa.array(keys, pa.int64()),
            pa.array(list(map(len, ids)), pa.int64()),
            pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: number of ids and digests of the ids and of the decoded text.

    The digests are taken in the task that encodes, so that neither ids nor texts move.
    """
    check_model(model)
    return texts(docs).mapInArrow(
        lambda it: _digests(it, model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
