"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, materialize, read_table

SHARDS = 24


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the one of least ``-ln(u) / weight``, where ``u`` in (0, 1) is a hash of key and shard.

    Key and weights alone decide.  A new shard draws only the keys for which its
    own value is least, a removed shard gives its keys to the others in
    proportion, and a changed weight moves keys to or from that shard only.
    Shards of weight 0 get nothing; a tie goes to the lower number.  A null key
    is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights are 0 or more, one at least above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_slots(df: DataFrame, shard: str, slot: str) -> DataFrame:
    """Numbers the rows of each shard from 0, without gaps and without a shuffle of the rows.

    Each task numbers its own rows by shard, and rows are written with that number
    and the task's; a running sum over counts by task and shard gives each task's
    first slot.  What is added up was written once, so it does not matter how the
    written table is cut when it is read again, or by how many executors.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_slot: defaultdict[int, int] = defaultdict(int)
        for batch in batches:
            shards = batch.column(shard).to_numpy(zero_copy_only=False)
            slots = np.empty(len(shards), dtype=np.int64)
            for s in np.unique(shards).tolist():
                at = np.flatnonzero(shards == s)
                slots[at] = next_slot[s] + np.arange(len(at))
                next_slot[s] += len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots)], [*batch.schema.names, "_own"])

    here = df.withColumn("_part", F.spark_partition_id())
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema) + ", _own long"
    numbered = materialize(here.mapInArrow(number, ddl), "shards")
    counts = numbered.groupBy("_part", shard).count()
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", shard, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    if counts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    return numbered.join(firsts, ["_part", shard]).withColumn(slot, F.col("_first") + F.col("_own")).drop("_part", "_first", "_own")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Each document's size, checksum, shard, slot in the shard, and shard after growing to ``grown``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A null text has no
    bytes (size 8, checksum 0), a null id is a key of its own, repeated rows get
    slots of their own, an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return with_slots(rows, "shard", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """Writes every column of the rows to one folder a shard, ``path/shard=N``, in files of bounded size."""
    rows = docs.withColumn("shard", rendezvous_shard(F.col(key), weights))
    rows.write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards, and over 25."""
    return shard_documents(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
