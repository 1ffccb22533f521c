"""A sink that keeps a ledger: payloads by event, each batch listed once.

Tasks write files under names of their own; the commit of a batch writes its entry,
which lists them, under the batch's number.  A batch that fails leaves no entry and
its files are deleted; one that is run again after its entry was written (the stream
died before its checkpoint) leaves the entry as it is.  So each event of a batch is
delivered once, and a reader sees whole batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Delivered(WriterCommitMessage):
    file: str | None
    rows: int


class LedgerWriter(DataSourceStreamArrowWriter):
    """Writes ``event_id`` and ``payload`` (strings) of a batch."""

    def __init__(self, path: str, schema: StructType):
        self._path = path
        if not {"event_id", "payload"} <= set(schema.names):
            raise ValueError("a ledger takes event_id and payload")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Delivered:
        fs, base = _filesystem(self._path)
        fs.create_dir(f"{base}/payloads", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for batch in iterator:
                for row in batch.select(["event_id", "payload"]).to_pylist():
                    out = out or fs.open_output_stream(f"{base}/payloads/{name}", compression=None)
                    out.write((json.dumps(row) + "\n").encode())
                    rows += 1
        finally:
            if out is not None:
                out.close()
        return Delivered(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        from pyarrow.fs import FileType

        fs, base = _filesystem(self._path)
        fs.create_dir(f"{base}/entries", recursive=True)
        entry = f"{base}/entries/{batchId:012}.json"
        if fs.get_file_info(entry).type == FileType.File:
            return self.abort(messages, batchId)
        files = [m.file for m in messages if m is not None and m.file]
        part = f"{base}/entries/.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(json.dumps({"batch": batchId, "files": files, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        fs.move(part, entry)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, base = _filesystem(self._path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{base}/payloads/{m.file}")


class Ledger(DataSource):
    """``stream.writeStream.format("ledger").start(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return "event_id string, payload string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LedgerWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ledger)


def deliver(payloads: DataFrame, path: str, checkpoint: str):
    """Runs a stream of payloads (event_id, payload) into a ledger over all that is there; an event twice in a batch is one row."""
    register(payloads.sparkSession)
    return payloads.select("event_id", "payload").writeStream.format("ledger").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """What a ledger lists: event_id, payload, batch; of an event that came more than once the first batch's, and of that the least, as a receiver keeps one by its key."""
    entries = spark.read.schema("batch long, files array<string>").json(f"{path}/entries/*.json").select("batch", F.explode("files").alias("file"))
    rows = spark.read.schema("event_id string, payload string").json(f"{path}/payloads").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = rows.join(entries, "file")
    first = Window.partitionBy("event_id").orderBy("batch", "payload")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("event_id", "payload", "batch")
