"""Polls of feeds as a Spark data source, by batch and as a stream with an offset for each feed.

A folder has a folder a feed, and in it what each poll brought, named by its time in
milliseconds: ``1700000000000.xml`` is a document, ``.error`` the message of a poll
that failed.  An empty document stands for "not modified".  Other names are passed over.

A poll whose document has the bytes of the feed's document before it is quiet: it is a
row without a document, so nothing is parsed again.  This is what a conditional
request saves where the server takes part in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewire.sources.feeds import ATOM_SCHEMA, RSS_SCHEMA, parse_feed

SCHEMA = "source_id string, polled_at timestamp, ok boolean, quiet boolean, error string, xml string"
_NAME = re.compile(r"(\d{1,15})\.(xml|error)")
#: Polls of a feed to a partition, and rows to an Arrow batch; documents are one poll's.
POLLS, ROWS = 500, 64


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Polls(InputPartition):
    """Some polls of a feed in order of time, and the document before them."""

    source_id: str
    files: list[str]
    before: str | None


def _listed(base: str) -> dict[str, list[str]]:
    """Of each feed's folder the names of its polls, in order of time."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = _filesystem(base)
    found: dict[str, list[str]] = {}
    for info in fs.get_file_info(FileSelector(path, recursive=True, allow_not_found=True)):
        parts = info.path[len(path) :].strip("/").split("/")
        if info.type == FileType.File and len(parts) == 2 and _NAME.fullmatch(parts[1]):
            found.setdefault(parts[0], []).append(parts[1])
    return {feed: sorted(names, key=_order) for feed, names in sorted(found.items())}


def _order(name: str) -> tuple[int, str]:
    return int(name.split(".")[0]), name


def _parts(feed: str, names: list[str], before: list[str]) -> Iterator[Polls]:
    """Partitions of a feed's polls; each one's document before it is the last one of those that stand before."""
    earlier = [n for n in before if n.endswith(".xml")]
    for at in range(0, len(names), POLLS):
        here = names[at : at + POLLS]
        yield Polls(feed, here, earlier[-1] if earlier else None)
        earlier += [n for n in here if n.endswith(".xml")]


def _read(base: str, part: Polls, schema: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fs, path = _filesystem(base)
    arrow = to_arrow_schema(schema)

    def content(name: str) -> bytes:
        with fs.open_input_stream(f"{path}/{part.source_id}/{name}", compression=None) as f:
            return f.read()

    last = hashlib.sha256(content(part.before)).digest() if part.before else None
    rows = []
    for name in part.files:
        data, at = content(name), _order(name)[0]
        error, xml = None, None
        if name.endswith(".error"):
            error = data.decode("utf-8", "replace") or "unknown error"
        elif data:
            digest = hashlib.sha256(data).digest()
            xml, last = (None if digest == last else data.decode("utf-8", "replace")), digest
        rows.append({"source_id": unquote(part.source_id), "polled_at": at * 1000, "ok": error is None, "quiet": error is None and xml is None, "error": error, "xml": xml})
        if len(rows) >= ROWS:
            yield _batch(rows, arrow)
            rows = []
    if rows:
        yield _batch(rows, arrow)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)


class PollReader(DataSourceReader):
    """All polls of a folder; partitions are of one feed each."""

    def __init__(self, base: str, schema: StructType):
        self.base, self.schema = base, schema

    def partitions(self) -> Sequence[InputPartition]:
        return [p for feed, names in _listed(self.base).items() for p in _parts(feed, names, [])] or [Polls("", [], None)]

    def read(self, partition: Polls) -> Iterator[pa.RecordBatch]:
        return _read(self.base, partition, self.schema)


class PollStream(DataSourceStreamReader):
    """The polls that came since: an offset is each feed's last poll, so feeds go on by themselves, however late one is."""

    def __init__(self, base: str, schema: StructType):
        self.base, self.schema = base, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: names[-1] for feed, names in _listed(self.base).items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts: list[Polls] = []
        for feed, names in _listed(self.base).items():
            done = [n for n in names if feed in start and _order(n) <= _order(start[feed])]
            now = [n for n in names[len(done) :] if feed in end and _order(n) <= _order(end[feed])]
            parts += _parts(feed, now, done)
        return parts or [Polls("", [], None)]

    def read(self, partition: Polls) -> Iterator[pa.RecordBatch]:
        return _read(self.base, partition, self.schema)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedPolls(DataSource):
    """``spark.read.format("feed_polls").load(folder)`` and ``spark.readStream``."""

    @classmethod
    def name(cls) -> str:
        return "feed_polls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PollReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PollStream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedPolls)


def outcomes(polls: DataFrame) -> DataFrame:
    """One row a poll: source_id, polled_at, ok, quiet, items, error.  A document that isn't a feed is a failed poll."""
    options = {"mode": "PERMISSIVE", "attributePrefix": "_"}
    rss = F.from_xml("xml", RSS_SCHEMA, options)["channel"]["item"]
    atom = F.from_xml("xml", ATOM_SCHEMA, options)["entry"]
    is_feed = F.col("xml").rlike("<(?:rss|rdf:RDF|RDF|feed)[\\s>]")
    items = F.when(F.col("xml").rlike("<feed[\\s>]"), F.size(atom)).otherwise(F.size(rss))
    bad = F.col("xml").isNotNull() & ~is_feed
    return polls.select(
        "source_id", "polled_at", (F.col("ok") & ~bad).alias("ok"), "quiet",
        F.when(F.col("xml").isNull() | bad, 0).otherwise(F.greatest(items, F.lit(0))).alias("items"),
        F.when(bad, "not a feed").otherwise(F.col("error")).alias("error"),
    )


def polled_items(polls: DataFrame) -> DataFrame:
    """The items of polls, as of ``parse_feed``, with the time of their poll."""
    key = F.to_json(F.struct(F.col("source_id"), F.unix_micros("polled_at").alias("at"))).alias("_poll")
    items = parse_feed(polls.where("xml IS NOT NULL").select(key, "xml"), source="_poll")
    poll = F.from_json("source_id", "struct<source_id:string,at:bigint>")
    return items.withColumn("polled_at", F.timestamp_micros(poll["at"])).withColumn("source_id", poll["source_id"])


def write_polls(polls: DataFrame, path: str) -> None:
    """Writes rows (source_id, polled_at, xml or error) as a folder of polls; a file is whole or not there."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(path)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{base}/{quote(row['source_id'], safe='')}"
                fs.create_dir(folder, recursive=True)
                name = f"{row['ms']}.{'xml' if row['error'] is None else 'error'}"
                with fs.open_output_stream(f"{folder}/.{name}.part", compression=None) as out:
                    out.write((row["xml"] or "").encode() if row["error"] is None else row["error"].encode())
                fs.move(f"{folder}/.{name}.part", f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows = polls.select("source_id", F.unix_millis(F.col("polled_at").cast("timestamp")).alias("ms"), "xml", "error")
    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()
