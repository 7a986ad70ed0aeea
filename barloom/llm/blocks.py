"""Documents dealt to blocks of bounded size and packed: for operators that handle many texts at a time.

A block is a share, by hash, of one input partition, so that a row is in the same block however often, and in whatever
order, its partition is computed; repeated rows of different partitions are in different blocks. Blocks are moved
between tasks in compressed packs, and the same shuffle of packs serves every step of an operator that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_BYTES = 4 << 20


def pack(docs: DataFrame, id_col: str, text_col: str, block_chars: int, by: tuple[str, ...] = ("id", "text")) -> tuple[DataFrame, int]:
    """(block int, docs binary), and a bound of the number of blocks. The packed rows are (id, text), null text as empty, dealt by a hash of by."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("text")).alias("n"))
    most, last = part.agg(F.max("n"), F.max("p")).first()
    shares = max(1, -(-(most or 0) // block_chars))
    block = F.spark_partition_id() * shares + F.pmod(F.xxhash64(*by), F.lit(shares)).cast("int")
    return rows.withColumn("block", block).mapInArrow(_packed, "block int, docs binary"), ((last or 0) + 1) * shares


def _packed(batches):
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}

    def flush(block: int) -> pa.RecordBatch:
        rows, sink = held.pop(block), pa.BufferOutputStream()
        size.pop(block)
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        own = batch.select(["id", "text"])
        for block in np.unique(blocks).tolist():
            rows = own.filter(pa.array(blocks == block))
            held.setdefault(block, []).append(rows)
            size[block] = size.get(block, 0) + rows.nbytes
            if size[block] > PACK_BYTES:
                yield flush(block)
    for block in list(held):
        yield flush(block)


def batches_of(block: pa.Table):
    """The record batches (id, text) of a block's packs."""
    for x in block.column("docs"):
        yield from pa.ipc.open_stream(x.as_buffer())


def texts_of(block: pa.Table):
    for docs in batches_of(block):
        yield from docs.column("text").to_pylist()
