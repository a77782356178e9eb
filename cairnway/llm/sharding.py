"""Sharding by jump consistent hashing.

A stable key and the shard count decide the shard: there is no ring table, and
one more shard takes rows only into itself, about one row in ``n + 1``.  The
jumps run vectorised over Arrow batches of 8-byte keys; no text reaches Python.

Slots are gapless inside each shard.  A shard is never gathered into one task, and neither is a key:
each task numbers its own rows by shard while it deals them out, the numbered rows are staged, the
counts by (task, shard) are summed up in order of tasks, and a row's slot is its task's start in its shard plus its
number.  Nothing is sorted, and equal rows, however many, stay where they are.  The starts, one row a task, are joined
by task; Spark broadcasts them where their size allows it.

Defined results: a null key hashes as the text ``null``; rows that repeat a key
share its shard and get different slots; which row of a shard gets which slot depends on how the rows are partitioned;
an empty table gives an empty result; input columns named like added ones are replaced, others are returned as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.llm.common import with_renamed_clashes, working_name
from cairnway.plans.staging import staged

#: The linear congruential multiplier of the published jump hash (fixed value).
JUMP_MULTIPLIER = np.uint64(2862933555777941757)
ADDED = ["shard", "slot", "grown_shard"]


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0 to ``shards - 1``, of each unsigned 64-bit key."""
    key, out, live = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.arange(len(keys))
    at = np.zeros(len(keys), np.int64)
    while live.size:
        out[live] = at[live]
        key[live] = key[live] * JUMP_MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[live] = ((out[live] + 1) * step).astype(np.int64)
        live = live[at[live] < shards]
    return out


def numbered(shard: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each row's number among those of its shard; ``seen`` counts rows by shard and goes on."""
    order = np.argsort(shard, kind="stable")
    counts = np.bincount(shard, minlength=len(seen))
    starts = np.cumsum(counts) - counts
    out = np.empty(len(shard), np.int64)
    out[order] = np.arange(len(shard)) - starts[shard[order]] + seen[shard[order]]
    seen += counts
    return out


def jump_hash(key: Column, shards: int) -> Column:
    """``struct<shard, grown, i>`` of a long column without nulls: the shard, that among one more, and the row's number in its task and shard."""

    @F.arrow_udf("struct<shard:int,grown:int,i:long>")
    def shard_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(shards, np.int64)  # an iterator reads the rows of one task
        for keys in batches:
            hashed = np.asarray(keys).view(np.uint64)
            shard, grown = jump(hashed, shards), jump(hashed, shards + 1)
            columns = [pa.array(shard.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(numbered(shard, seen))]
            yield pa.StructArray.from_arrays(columns, ["shard", "grown", "i"])

    return shard_of(key)


def assign_shards(rows: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``shard``, its gapless ``slot`` and ``grown_shard``, the shard if there were one more."""
    rows = with_renamed_clashes(rows, ADDED)
    at, task, starts = (working_name(rows, x) for x in ("_at", "_task", "_starts"))
    hashed = F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    dealt = staged(rows.select("*", jump_hash(hashed, shards).alias(at), F.spark_partition_id().alias(task)), "shards")
    counts = dealt.groupBy(F.col(task).alias("task"), F.col(f"{at}.shard").alias("shard")).agg(F.max(f"{at}.i").alias("last"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task and shard
    begun = counts.select("task", "shard", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("start"))
    tables = staged(begun.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("shard", "start"))).alias("starts")), "shard-starts")
    joined = dealt.join(tables.select(F.col("task").alias(task), F.col("starts").alias(starts)), task)
    slot = F.element_at(starts, F.col(f"{at}.shard")) + F.col(f"{at}.i")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(f"{at}.shard").alias("shard"), slot.alias("slot"), F.col(f"{at}.grown").alias("grown_shard"))
