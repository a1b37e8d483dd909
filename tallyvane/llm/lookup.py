"""Blocks of rows that ask a large keyed table for just the keys they hold.

A table of statistics over all texts grows with them, so it can't be broadcast; sending every text's keys to it costs as much as
the texts many times over. Instead rows are dealt to blocks of bounded size, each block asks once for each key it holds, and
the answers go to the block's rows. A key that every text holds is asked for once a block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyvane.llm import shared
from tallyvane.llm.bpe import blocks


def dealt(rows: DataFrame, column: str, piece: int, size: int, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """The rows, or what `made` makes of them in the same worker, in blocks, written: block, and rows in a compressed Arrow stream. Rows that stand together make a piece, one row of the
    result, with about `piece` bytes in `column`, and pieces a block with about `size`. A block is of one task, so its size
    doesn't depend on any key."""

    def run(batches):
        task = TaskContext.get().partitionId()
        number = have = 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for table in blocks(made(batches), column, piece):
            if have >= size:
                number, have = number + 1, 0
            have += max(table.column(column).nbytes, 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
                stream.write_table(table.combine_chunks())
            yield pa.record_batch([pa.array([task << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return shared.written(rows.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.BinaryType())])), "blocks")


def unpacked(rows: bytes) -> pa.Table:
    """The rows of a piece."""
    return pa.ipc.open_stream(rows).read_all()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """block and rows of every piece of a task's batches of blocks."""
    for batch in batches:
        for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
            yield block, unpacked(rows.as_buffer())


def answered(rows: DataFrame, answers: DataFrame, prepare: Callable[[pa.Table], Any], function: Callable[[pa.Table, Any], pa.Table], schema: T.StructType) -> DataFrame:
    """function(rows of a piece, what prepare() made of its block's answers) for every piece; rows are of dealt(), answers have the column
    `block`. The partitions follow the number of blocks, so that more data are more tasks and no larger ones."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.select("block").distinct().count())
    left, right = (x.repartition(n, "block").groupBy("block") for x in (rows, answers))

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        made, done = prepare(told), []
        del told
        for piece in own.column("rows"):
            shared.give_back()
            done.append(function(unpacked(piece.as_buffer()), made))
        return pa.concat_tables(done) if done else schema_table(schema)

    return left.cogroup(right).applyInArrow(run, schema)


def schema_table(schema: T.StructType) -> pa.Table:
    """A table without rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
