"""Every row against every block of a model that is itself a table.

Rows are packed into chunks and written; every pair of a chunk and a block of the model is worked on in some task, and
what a chunk gets from all blocks is added up. Neither the rows nor the model pass through the driver.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.sources.store import settle

#: Rows of a chunk, and sums of chunks that a task holds at once.
CHUNK_ROWS, HELD_SUMS = 1024, 64


def crossed(
    rows: DataFrame, features: tuple[str, ...], model: DataFrame, part: Callable, shape: Callable, name: str, kind: T.DataType
) -> DataFrame:
    """The rows with a column: ``shape`` of the sum of ``part(block, x)`` over all blocks of the model.

    ``x`` is a matrix of the features, a column that the table lacks is 0; a block is a row of the model, whose first
    column numbers it. Sums are added in the order of the blocks.
    """
    spark = rows.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kinds, width = T.StructType([*rows.schema.fields]), len(features)
    x = F.array(*[F.col(c).cast("double") if c in rows.columns else F.lit(0.0) for c in features])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                flat = some.column(some.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rest = pa.RecordBatch.from_arrays(some.columns[:-1], some.schema.names[:-1])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                one = [uuid.uuid4().hex], [flat.tobytes()], [sink.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array(one[0]), *[pa.array(v, pa.binary()) for v in one[1:]]], ["chunk", "x", "rest"])

    chunks = settle(rows.withColumn("_x", x).mapInArrow(packed, "chunk string, x binary, rest binary"), "chunks")

    def sums(pairs: Iterator[tuple]) -> Iterator[tuple]:
        held = {}
        for (chunk, data), block in pairs:
            found = part(block, np.frombuffer(data).reshape(-1, width))
            first, total = held.get(chunk, (block[0], 0.0))
            held[chunk] = (first, total + found)
            if len(held) > HELD_SUMS:
                yield from ((c, first, np.ascontiguousarray(v).tobytes()) for c, (first, v) in held.items())
                held = {}
        yield from ((c, first, np.ascontiguousarray(v).tobytes()) for c, (first, v) in held.items())

    pairs = chunks.select("chunk", "x").rdd.map(tuple).cartesian(model.rdd.map(tuple))
    added = spark.createDataFrame(pairs.mapPartitions(sums), "chunk string, first long, part binary")
    of_chunk = added.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("first", "part"))).alias("parts"))
    both = chunks.select("chunk", "rest").join(of_chunk, "chunk", "left").select("rest", F.col("parts.part").alias("parts"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, parts in zip(batch.column(0), batch.column(1)):
                [own] = pa.ipc.open_stream(rest.as_buffer())
                total = np.sum([np.frombuffer(p.as_buffer()) for p in parts], axis=0) if parts.is_valid else np.zeros(own.num_rows)
                yield pa.RecordBatch.from_arrays([*own.columns, shape(total, own.num_rows)], [*own.schema.names, name])

    return both.mapInArrow(unpacked, kinds.add(name, kind))
