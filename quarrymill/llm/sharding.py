"""Operator 10: sharding by jump consistent hashing.

The shard of a row follows from its key and the shard count alone. No ring
table is kept; with one more shard, a row either stays or goes to the new one.

A slot (gapless from 0 within a shard, in key order) is found without
gathering a shard in one task: rows are range-partitioned by (shard, key), so
a shard spans many partitions, numbered within each partition, and shifted by
the row counts of earlier partitions. Those counts are one row for each
partition and shard in it, so what is broadcast is bounded by the number of
partitions plus the number of shards.

Defined results: a null text counts as no bytes (size 1, crc32 0); a null key
hashes as ``NULL_KEY``; repeated rows get a slot each, ties in key order are
broken by crc32 and size; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

# Fixed values of jump consistent hashing (published algorithm): multiplier and 2^31.
MULTIPLIER = np.uint64(2862933555777941757)
SCALE = float(1 << 31)
NULL_KEY = -1


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys step together until each has left the range."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    alive = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(alive):
            bucket[alive] = jump[alive]
            state[alive] = state[alive] * MULTIPLIER + np.uint64(1)
            high = (state[alive] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[alive] = ((bucket[alive] + 1).astype(np.float64) * (SCALE / high)).astype(np.int64)
            alive = alive[jump[alive] < shards]
    return bucket.astype(np.int32)


def _add_shards(shards: int):
    def run(batches):
        for batch in batches:
            key = batch.column("key").fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump_hash(key, shards)), pa.array(jump_hash(key, shards + 1))],
                names=[*batch.schema.names, "shard", "grown_shard"],
            )

    return run


def _number(batches):
    """Index of each row among its partition's rows of the same shard (rows come sorted by shard)."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        index = np.empty(len(shard), np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            index[at] = np.arange(len(at)) + seen.get(int(s), 0)
            seen[int(s)] = seen.get(int(s), 0) + len(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(index)],
            names=[*batch.schema.names, "part", "at"],
        )


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    fields = [*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]
    # Written first: the range partitioner samples its input, which must not mean reading the texts twice.
    placed = materialise(rows.mapInArrow(_add_shards(shards), T.StructType(fields)), "placed")
    order = ["shard", "key", "text_crc32", "size"]
    fields += [T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())]
    numbered = materialise(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, T.StructType(fields)), "numbered"
    )
    counts = numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # partitions + shards rows at most
    starts, total = [], {}
    for r in sorted(counts):
        starts.append((r["shard"], r["part"], total.get(r["shard"], 0)))
        total[r["shard"]] = total.get(r["shard"], 0) + r["n"]
    offsets = spark.createDataFrame(starts, "shard int, part int, start long")
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard"
    )
