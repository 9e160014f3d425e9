"""Operator 5: contiguous balanced shards from global byte-size prefix sums.

Only (id, size, checksum) is shuffled, by range.  An Arrow pass numbers the rows of each
partition and adds up its sizes; the rows are written to the shared folder, so the totals and
the offsets come from the same partitioning.  The totals, one row a partition, are gathered on
the driver; a row's global start is its partition's offset plus its own, and its shard is that
of its middle byte among equal targets.  So shards are contiguous in id order and a shard's
bytes differ from the target by no more than one row's size.

The law is ``bytes``: sizes decide alone, so rows of equal texts are not kept together unless
their ids are neighbours, and another number of shards moves rows.

Defined results: a null text has size ``overhead`` and checksum 0.  Null ids sort first.
Repeated ids follow each other in the order of size and checksum.  A shard may stay empty if
there are fewer rows than shards.  An empty table gives no An empty table gives no rows.  Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage

SHARDS = 24
OVERHEAD = 8


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, start (bytes before the row), shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes, n = batch.column(1).to_numpy(), batch.num_rows
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(seen + np.arange(n)), pa.array(ends - sizes)], names=["doc_id", "size", "text_crc32", "part", "at", "before"])
            seen, before = seen + n, int(ends[-1]) if n else before

    ordered = rows.repartitionByRange("doc_id", "size", "text_crc32").sortWithinPartitions("doc_id", "size", "text_crc32")
    table = storage.materialise(ordered.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, part int, at long, before long"), "sized-rows")
    return _cut(table, shards)


def _cut(table: DataFrame, shards: int) -> DataFrame:
    spark = table.sparkSession
    totals = table.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    offsets, start, first = [], 0, 0
    for t in totals:
        offsets.append((t.part, start, first))
        start, first = start + t.bytes, first + t["rows"]
    # One row a partition, and below one row a shard: both bounded, whatever the input.
    bases = F.broadcast(spark.createDataFrame(offsets, "part int, byte_base long, row_base long"))
    total = max(start, 1)
    placed = table.join(bases, "part").select("doc_id", "size", "text_crc32", (F.col("byte_base") + F.col("before")).alias("start"), (F.col("row_base") + F.col("at")).alias("row"))
    placed = placed.withColumn("shard", F.expr(f"least({shards - 1}, cast(((2 * start + size) * {shards}) div {2 * total} as int))"))
    heads = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("head")))
    return placed.join(heads, "shard").select("doc_id", "size", "text_crc32", "start", "shard", (F.col("row") - F.col("head")).alias("slot"))
