"""Tables kept in buckets of their key: an upsert rewrites what it touches, and retention drops whole days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.merge import upsert
from tidewire.sources.shared import written

BUCKETS = 64


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _overwrite(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that the rows have, and no others."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def create_table(rows: DataFrame, path: str, keys: Sequence[str], version: str, keep_known: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """Writes a table of one row a key, a folder a bucket; the table's buckets are fixed from then on."""
    newest = upsert(rows, rows.limit(0), keys, version, keep_known)
    newest.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], version: str, keep_known: Sequence[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Puts rows into a table, as ``merge.upsert`` would into all of it; returns the buckets that were read and rewritten.

    Rows meet the table bucket by bucket: of others no file is read, by partition
    pruning, or written, by dynamic overwriting.  The merged buckets are written aside
    before they replace anything, so a job that fails leaves the table as it was.
    """
    incoming = written(incoming.withColumn("bucket", bucket_of(keys, buckets)))
    touched = sorted(r[0] for r in incoming.select("bucket").distinct().collect())
    if not touched:
        return []
    current = spark.read.schema(incoming.schema).parquet(path).where(F.col("bucket").isin(touched))
    merged = written(upsert(current, incoming, [*keys, "bucket"], version, keep_known))
    _overwrite(merged, path, "bucket")
    return touched


def create_daily(rows: DataFrame, path: str, ts: str) -> None:
    """Writes rows in a folder a day of their time."""
    rows.withColumn("day", F.to_date(ts)).repartition("day").write.partitionBy("day").parquet(path)


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Removes the days before a date (``2024-01-15``); nothing else is read or written.  Returns the days removed."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    days = sorted(i.base_name.partition("=")[2] for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.startswith("day="))
    gone = [d for d in days if d < before and d != "__HIVE_DEFAULT_PARTITION__"]
    for day in gone:
        store.delete_dir(f"{base}/day={day}")
    return gone
