"""What the operators share: the folder that all executors see, tables written there, and checks of size."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its rows, counted first, are no more than this.
BROADCAST_ROWS = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent and all runs in one process (tests), it is set to a
    temporary folder of this machine; on a cluster it has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewire-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the table to the shared folder and reads it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that a task no longer uses to the system: Python workers are kept, and other stages use them next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def put_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """Rows whose columns by names that an operator adds are renamed meanwhile, and what selects the rows' own columns again."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in set(names)}
    return docs.withColumnsRenamed(aside), [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
