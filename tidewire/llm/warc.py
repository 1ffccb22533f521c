"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files.  Predicates on the type and on the other
header fields are pushed to the source: a record's header is parsed first, and a
record that they leave out is passed over without its payload being inflated or
copied.  The schema given to the reader says what is wanted; without a ``payload``
column no payload is decoded.

Written records are gzip members of their own, with the lengths of the member in the
``sl`` field that the format reserves for it, so that a reader seeks over a record.
Members without it (of other writers) are inflated and thrown away, and ``.warc``
files without compression are sought over by ``Content-Length``.

A task writes files under names of its own; the commit lists them in a manifest, and
where a folder has manifests only what they list is read.  So tasks can be run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidewire.llm.common import BROADCAST_ROWS, materialize, read_table, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, digest string, content_type string, payload_bytes long, payload binary, headers map<string,string>"
#: Columns and the header fields that they are read from.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "digest": "warc-payload-digest",
    "content_type": "content-type",
}
#: Fixed value: the profile of records that repeat a payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed beyond this; files are read together up to this; bytes of payloads and rows to an Arrow batch.
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 512 << 20, 64 << 20, 8 << 20, 2_000
#: Bytes read at once, and inflated at once.
READ_BYTES, STEP = 1 << 20, 1 << 16
#: Payloads shorter than this are always written whole.
REVISIT_BYTES = 1_000
_GAP = b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def hex_digest(value: str | None) -> str | None:
    """A header's digest as lower-case hex, its algorithm left out; base 32 is the custom, hex is taken too."""
    if not value:
        return None
    algorithm, _, text = value.rpartition(":")
    if algorithm.lower() in ("sha1", "") and re.fullmatch("[A-Za-z2-7]{32}", text):
        return base64.b32decode(text.upper()).hex()
    return text.lower()


# ---------------------------------------------------------------- writing


def _line(name: str, value: str | None) -> str:
    """A header line; characters that would end it are percent-encoded, an absent value has none."""
    return "" if value is None else f"{name}: " + re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value) + "\r\n"


def record_bytes(row: dict[str, Any], date: str) -> bytes:
    """A record as it stands in an archive.

    A response has its payload behind an HTTP header.  A revisit has the header
    alone, whose length is that of the payload it does without.
    """
    kind, payload = row["record_type"], row.get("payload") or b""
    size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    digest = bytes.fromhex(row["digest"]) if row.get("digest") else hashlib.sha1(payload).digest()
    if kind in ("response", "revisit"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=UTF-8'}\r\nContent-Length: {size}\r\n\r\n".encode()
        media = "application/http; msgtype=response"
    else:
        block, media = b"", row.get("content_type") or "application/octet-stream"
    if kind != "revisit":
        block += payload
    refers = row.get("refers_to")
    head = "".join(
        (
            "WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", f"<{row['record_id']}>"), _line("WARC-Date", row.get("date") or date),
            _line("WARC-Target-URI", row.get("target_uri")), _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
            _line("WARC-Refers-To", f"<{refers}>" if refers is not None else None), _line("WARC-Profile", SAME_PAYLOAD if kind == "revisit" else None),
            _line("Content-Type", media), _line("Content-Length", str(len(block))), "\r\n",
        )
    )
    return head.encode() + block + _GAP


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member, its own length and that of the data in the ``sl`` field (left out beyond 32 bits)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 14 + len(body) + 8
    extra = struct.pack("<HBBHII", 12, 0x73, 0x6C, 8, total, len(data)) if max(total, len(data)) < 1 << 32 else b""
    flags = 4 if extra else 0
    return struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, flags, 0, 0, 255) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: file, bytes, and records by type."""

    files: list[tuple[str, int, dict[str, int]]]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (``record_id``, ``record_type``; the other columns of ``SCHEMA`` as they are there) to archives."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self._base, self._overwrite = options["path"], overwrite
        self._level, self._limit = int(options.get("level", "4")), int(options.get("filebytes", FILE_BYTES))
        self._date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self._names = schema.names
        if not {"record_id", "record_type"} <= set(self._names):
            raise ValueError("an archive needs record_id and record_type")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _filesystem(self._base)
        fs.create_dir(base, recursive=True)
        files: list[tuple[str, int, dict[str, int]]] = []
        out, name, size, kinds = None, "", 0, Counter()

        def end() -> None:
            if out is not None:
                out.close()
                files.append((name, size, dict(kinds)))

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self._limit:
                    end()
                    name, size, kinds = f"part-{uuid.uuid4().hex}.warc.gz", 0, Counter()
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = {"record_id": f"urn:uuid:{uuid.uuid4()}", "record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
                    size += out.write(gzip_member(record_bytes(info, self._date), self._level))
                size += out.write(gzip_member(record_bytes(row, self._date), self._level))
                kinds[row["record_type"]] += 1
        end()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self._base)
        fs.create_dir(base, recursive=True)
        before = _manifests(fs, base) if self._overwrite else []
        lines = [json.dumps(f) for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.jsonl", compression=None) as out:
            out.write("\n".join(lines).encode())
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self._base)
        for name in (f[0] for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{base}/{name}")


def _manifests(fs, base: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(i.path for i in fs.get_file_info(FileSelector(base)) if re.fullmatch(r"manifest-\w+\.jsonl", i.base_name))


# ---------------------------------------------------------------- reading


class _Window:
    """A file by places: what was read last is kept, places beyond it are read from there, and what lies between is not."""

    def __init__(self, file):
        self._file, self._size, self._from, self._held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place; fewer at the end of the file."""
        n = min(n, self._size - at)
        if n <= 0:
            return b""
        if at < self._from or at + n > self._from + len(self._held):
            self._from, self._held = at, self._file.read_at(min(max(n, READ_BYTES), self._size - at), at)
        return self._held[at - self._from : at - self._from + n]


class _Plain:
    """The bytes of a record in a file without compression."""

    def __init__(self, window: _Window, at: int):
        self._window, self._start, self._at = window, at, at

    def more(self) -> bytes:
        data = self._window.get(self._at, STEP)
        self._at += len(data)
        return data

    def end(self, length: int) -> int:
        return self._start + length


class _Member:
    """The inflated bytes of a gzip member."""

    def __init__(self, window: _Window, at: int):
        head = window.get(at, 12)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        flags, self._length, place = head[3], None, at + 10
        if flags & 4:
            (n,) = struct.unpack("<H", head[10:12])
            extra, place = window.get(at + 12, n), at + 12 + n
            while len(extra) >= 4:
                kind, (k,) = extra[:2], struct.unpack("<H", extra[2:4])
                if kind == b"sl" and k == 8:
                    self._length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + k :]
        for flag in (8, 16):
            if flags & flag:
                while window.get(place, 1) != b"\0":
                    place += 1
                place += 1
        place += 2 if flags & 2 else 0
        self._window, self._start, self._at, self._inflate = window, at, place, zlib.decompressobj(-15)

    def more(self) -> bytes:
        data = b""
        while not data and not self._inflate.eof:
            raw = self._inflate.unconsumed_tail
            if not raw:
                raw = self._window.get(self._at, STEP)
                self._at += len(raw)
            if not raw:
                raise ValueError(f"the gzip member at byte {self._start} is cut off")
            data = self._inflate.decompress(raw, STEP)
        return data

    def end(self, length: int) -> int:
        """Where the next member is: by its own length, or by inflating what is left."""
        if self._length is not None:
            return self._start + self._length
        while not self._inflate.eof:
            self.more()
        return self._at - len(self._inflate.unused_data) + 8


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines are joined, of repeated names the first counts."""
    found: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


class Record:
    """A record under the reader: its header is parsed, and its block is read when asked for."""

    def __init__(self, source: _Plain | _Member):
        self._source, self._data = source, b""
        head = self._until(_GAP)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        self._block = len(head) + len(_GAP)
        self.headers = _fields(head)
        self.length = int(self.headers["content-length"])
        self._http: bytes | None = None

    def _until(self, mark: bytes, start: int = 0, limit: int | None = None) -> bytes | None:
        while (at := self._data.find(mark, start)) < 0:
            if limit is not None and len(self._data) >= limit or not (data := self._source.more()):
                return None
            self._data += data
        return self._data[start:at]

    def value(self, column: str) -> str | None:
        raw = self.headers.get(HEADER_OF[column])
        if column in ("record_id", "refers_to") and raw is not None:
            return raw.strip("<>")
        return hex_digest(raw) if column == "digest" else raw

    def http_head(self) -> bytes:
        """The HTTP header with its end, of a block that has one; else nothing."""
        if self._http is None:
            self._http = b""
            if self.headers.get("content-type", "").startswith("application/http"):
                head = self._until(_GAP, self._block, self._block + self.length)
                self._http = head + _GAP if head is not None and len(head) + len(_GAP) <= self.length else b""
        return self._http

    def payload_bytes(self) -> int:
        head = self.http_head()
        stated = _fields(head).get("content-length") if self.headers.get("warc-type") == "revisit" else None
        return int(stated) if stated is not None else self.length - len(head)

    def payload(self) -> bytes | None:
        """The payload; a revisit has none."""
        if self.headers.get("warc-type") == "revisit":
            return None
        parts, have = [self._data], len(self._data)
        while have < self._block + self.length:
            data = self._source.more()
            if not data:
                raise ValueError("a record is cut off")
            parts.append(data)
            have += len(data)
        self._data = b"".join(parts)
        return self._data[self._block + len(self.http_head()) : self._block + self.length]

    def end(self) -> int:
        return self._source.end(self._block + self.length + len(_GAP))


def records(file) -> Iterator[Record]:
    """The records of an open file, compressed by record or not at all."""
    window, at = _Window(file), 0
    while head := window.get(at, 2):
        record = Record((_Member if head == b"\x1f\x8b" else _Plain)(window, at))
        yield record
        at = record.end()


_OPS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def holds(predicate: Filter, value_of) -> bool | None:
    """Whether a predicate holds of a header, by ``value_of`` a column; None where SQL has null."""
    if isinstance(predicate, Not):
        inner = holds(predicate.child, value_of)
        return None if inner is None else not inner
    value = value_of(predicate.attribute[0])
    if isinstance(predicate, IsNull | IsNotNull):
        return (value is None) == isinstance(predicate, IsNull)
    if isinstance(predicate, EqualNullSafe):
        return value == predicate.value
    return None if value is None or predicate.value is None else _OPS[type(predicate)](value, predicate.value)


def _is_header_predicate(predicate: Filter) -> bool:
    inner = predicate.child if isinstance(predicate, Not) else predicate
    known = isinstance(inner, IsNull | IsNotNull | EqualNullSafe) or type(inner) in _OPS
    # ``In`` with a null among its values has three outcomes of its own: Spark keeps those.
    plain = not isinstance(inner, In) or None not in inner.value
    return known and plain and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_OF


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    """Reads the columns of a schema (of ``SCHEMA``) from a folder of archives, or from one."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self._base, self._schema = options["path"], schema
        self._verify = options.get("verify", "true").lower() == "true"
        self._limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self._predicates: list[Filter] = []
        known = {f.split()[0] for f in SCHEMA.split(", ")}
        if unknown := [c for c in schema.names if c not in known]:
            raise ValueError(f"archives have no {', '.join(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _is_header_predicate(f):
                self._predicates.append(f)
            else:
                yield f

    def _may_hold(self, kinds: dict[str, int]) -> bool:
        """Whether a file with records of these types can have one that is wanted."""
        of_type = [p for p in self._predicates if (p.child if isinstance(p, Not) else p).attribute[0] == "record_type"]
        return any(all(holds(p, lambda _, k=kind: k) for p in of_type) for kind in (*kinds, "warcinfo"))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, base = _filesystem(self._base)
        if fs.get_file_info(base).type == FileType.File:
            return [Files([base])]
        listed = _manifests(fs, base)
        if listed:
            lines = [json.loads(x) for m in listed for x in fs.open_input_stream(m, compression=None).read().decode().splitlines()]
            files = [(f"{base}/{name}", size) for name, size, kinds in lines if self._may_hold(kinds)]
        else:
            found = fs.get_file_info(FileSelector(base, recursive=True))
            files = sorted((i.path, i.size) for i in found if i.type == FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        parts, held = [], 0
        for path, size in files:
            if not parts or held + size > self._limit:
                parts.append(Files([]))
                held = 0
            parts[-1].names.append(path)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _filesystem(self._base)
        names, arrow = self._schema.names, to_arrow_schema(self._schema)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        for name in partition.names:
            with fs.open_input_file(name) as file:
                for record in records(file):
                    if not all(holds(p, record.value) for p in self._predicates):
                        continue
                    row = {c: record.value(c) for c in names if c in HEADER_OF}
                    if "headers" in names:
                        row["headers"] = list(record.headers.items())
                    if "payload_bytes" in names:
                        row["payload_bytes"] = record.payload_bytes()
                    if "payload" in names:
                        row["payload"] = payload = record.payload()
                        stated = record.headers.get("warc-payload-digest", "")
                        if self._verify and payload is not None and stated.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != hex_digest(stated):
                            raise ValueError(f"the payload of {record.value('record_id')} in {name} is not that of its digest")
                        size += len(payload or b"")
                    rows.append(tuple(row[c] for c in names))
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push predicates down to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) as records: a response each, or a revisit of the one with the same payload.

    Of pages with equal payloads of ``least`` bytes or more, the one of the largest
    id is the response.  A null html is an empty payload, a null url is left out of
    the header.  A null id is less than any other; rows that repeat the largest
    id and its payload are all responses, and if all ids of a payload are null, so
    are those.  An empty table gives an empty one.

    Digests alone are shuffled to find who revisits whom, and the revisits come back
    by their own ids, so that a payload of very many pages is no hot key; html moves
    only where there are more revisits than are broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("payload_bytes"))
    heads = materialize(rows.where(F.col("payload_bytes") >= least).select("page_id", "digest"), "payloads")
    groups = heads.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 AND kept IS NOT NULL").drop("n")
    repeats = materialize(heads.join(groups, "digest").where("page_id IS NULL OR page_id < kept").distinct(), "revisits")
    repeats = repeats.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "kept")
    if repeats.count() <= BROADCAST_ROWS:
        repeats = F.broadcast(repeats)
    rows = rows.join(repeats, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def urn(c: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))

    again = F.col("kept").isNotNull()
    return rows.select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, urn("kept")).alias("refers_to"), "digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What archives say of each page; digest and size of a response are taken from its payload, of a revisit from its header."""

    def page(c: str):
        return F.substring_index(F.col(c), ":", -1).try_cast("long")

    archives = spark.read.format("warc")
    whole = archives.schema("record_id string, record_type string, payload binary").load(path).where("record_type = 'response'")
    whole = whole.select(
        page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    heads = archives.schema("record_id string, record_type string, refers_to string, digest string, payload_bytes long").load(path).where("record_type = 'revisit'")
    return whole.union(heads.select(page("record_id"), "payload_bytes", F.col("digest"), "record_type", page("refers_to")))


def op12_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    register(spark)
    path = f"{shared_dir(spark)}/archives"
    page_records(read_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    return read_pages(spark, path)


def op12_sql() -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p),
    r AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND kept IS NOT NULL AND (page_id IS NULL OR page_id < kept) AS again FROM g)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN kept END AS refers_to FROM r"""
