"""Binary token files with a minimal perfect hash index from document keys to their ids.

A shard is two files.  ``*.ids`` has the ids of its documents one after another,
16 bits each, little-endian, nothing else.  ``*.idx`` has, little-endian:

- 8 bytes ``TWIDX002``, then 64-bit numbers: keys n, buckets m, rows r, ids;
- m 32-bit seeds of the buckets;
- n entries of 16 bytes, at the keys' slots: fingerprint and number of rows (32 bits
  each), first row (64 bits);
- r + 1 64-bit numbers: where each row's ids start, and where the last ends.

A key's bucket gives a seed, key and seed give its slot, and the fingerprint there
tells whether the key is in the shard (a key that isn't passes once in 2^32).  Rows
of one key follow each other.  A look-up reads one seed, one entry and two starts
a row, each at a place that is computed, however large the shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import materialize, read_table, shared_dir
from tidewire.llm.tokenization import encoder, vocabulary

MAGIC = b"TWIDX002"
HEAD = 40
#: An entry of the index.
ENTRY = np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<i8")])
#: Keys to a bucket of the index, on average.
BUCKET_KEYS = 4
#: Bytes of text to a shard, about, and the most shards: beyond that, shards grow.  Tasks
#: stream ids to the file and hold 16 bytes a document.
SHARD_BYTES, MAX_SHARDS = 24 << 20, 100_000
#: Texts encoded at once.
_TEXTS = 2048
#: Stands for a null key in files, which is less than any other; an id of this number is refused.
NULL_KEY = -(2**63)

_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return _mix(h + seeds.astype(np.uint64) * _C) % np.uint64(n)


@dataclass
class KeyIndex:
    """A minimal perfect hash of n different 64-bit keys: each has a slot of its own below n."""

    seeds: np.ndarray
    n: int

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[KeyIndex, np.ndarray]:
        """The index, and each key's slot.

        Buckets are placed from the largest: of each the first seed that sends all
        its keys to free slots.  Buckets of one key take any free slot, by trying on.
        """
        n = len(keys)
        m = -(-n // BUCKET_KEYS)
        h = key_hash(keys)
        bucket = bucket_of(h, m)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        ends = np.cumsum(sizes)
        seeds = np.zeros(m, dtype=np.uint32)
        taken = np.zeros(n, dtype=bool)
        slots = np.empty(n, dtype=np.int64)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if not size:
                break
            of = order[ends[b] - size : ends[b]]
            mine, first = h[of], 0
            while True:
                at = _slots(mine[None, :], (tries + np.uint64(first))[:, None], n).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if size > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hits = np.flatnonzero(good)
                if len(hits):
                    break
                first += len(tries)
            seeds[b] = first + hits[0]
            slots[of] = at[hits[0]]
            taken[at[hits[0]]] = True
        return cls(seeds, n), slots


def key_hash(keys: np.ndarray) -> np.ndarray:
    return _mix(keys.astype(np.int64).view(np.uint64))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h + _A) >> np.uint64(32)).astype(np.uint32)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(h ^ _C) % np.uint64(max(buckets, 1))).astype(np.int64)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard under names of its own; only what the manifest lists is ever read, so a task can be run again."""

    def __init__(self, base: str):
        self._fs, path = _filesystem(base)
        self._fs.create_dir(path, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}"
        self._path = f"{path}/{self.name}"
        self._ids = self._fs.open_output_stream(f"{self._path}.ids")
        self._keys: list[int] = []
        self._sizes: list[int] = []

    def add(self, key: int, packed: bytes) -> None:
        self._ids.write(packed)
        self._keys.append(key)
        self._sizes.append(len(packed) // 2)

    def close(self) -> tuple[str, int, int, int, int]:
        """Writes the index; returns name, rows, ids, least and greatest key."""
        self._ids.close()
        keys, first, n = np.unique(np.array(self._keys, dtype=np.int64), return_index=True, return_counts=True)
        index, slots = KeyIndex.build(keys)
        entries = np.empty(len(keys), dtype=ENTRY)
        entries["print"][slots], entries["rows"][slots], entries["first"][slots] = fingerprint(key_hash(keys)), n, first
        starts = np.concatenate([[0], np.cumsum(self._sizes)]).astype("<i8")
        with self._fs.open_output_stream(f"{self._path}.idx") as f:
            f.write(MAGIC + np.array([len(keys), len(index.seeds), len(self._keys), starts[-1]], dtype="<i8").tobytes())
            for a in (index.seeds.astype("<u4"), entries, starts):
                f.write(a.tobytes())
        return self.name, len(self._keys), int(starts[-1]), int(keys[0]), int(keys[-1])


class ShardReader:
    """Keyed access to a shard; opens its files, reads the head of the index, and of the rest only what keys ask for.

    A key costs a seed, an entry and two starts a row, read at places that are
    computed.  Where a good part of a shard is asked for, the arrays are read in one
    piece first, and the same places are looked up in them.
    """

    #: A shard's arrays are read whole for more keys than this share of it.
    WHOLE_SHARE = 1 / 16

    def __init__(self, base: str, name: str):
        fs, path = _filesystem(base)
        self._index, self._ids = fs.open_input_file(f"{path}/{name}.idx"), fs.open_input_file(f"{path}/{name}.ids")
        head = self._index.read_at(HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is not an index of this format")
        self.n, self._buckets, self._rows, _ = np.frombuffer(head, "<i8", 4, 8).tolist()
        self._entries = HEAD + 4 * self._buckets
        self._starts = self._entries + ENTRY.itemsize * self.n
        self._held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _at(self, place: int, kind, n: int = 1) -> np.ndarray:
        return np.frombuffer(self._index.read_at(np.dtype(kind).itemsize * n, place), kind)

    def hold(self) -> None:
        """Reads the index whole, if it isn't held."""
        self._held = self._held or (self._at(HEAD, "<u4", self._buckets), self._at(self._entries, ENTRY, self.n), self._at(self._starts, "<i8", self._rows + 1))

    def rows(self, keys: np.ndarray) -> list[range]:
        """The rows of each key; none for a key that isn't here."""
        if not self.n:
            return [range(0)] * len(keys)
        if len(keys) > self.WHOLE_SHARE * self.n:
            self.hold()
        h = key_hash(keys)
        buckets = bucket_of(h, self._buckets)
        seeds = self._held[0][buckets] if self._held else np.concatenate([self._at(HEAD + 4 * b, "<u4") for b in buckets.tolist()])
        slots = _slots(h, seeds, self.n).astype(np.int64)
        entries = self._held[1][slots] if self._held else np.concatenate([self._at(self._entries + ENTRY.itemsize * s, ENTRY) for s in slots.tolist()])
        n = np.where(entries["print"] == fingerprint(h), entries["rows"], 0)
        return [range(a, a + k) for a, k in zip(entries["first"].tolist(), n.tolist())]

    def ids(self, row: int) -> tuple[int, np.ndarray]:
        """Where a row's ids start in the shard, and the ids."""
        a, b = (self._held[2][row : row + 2] if self._held else self._at(self._starts + 8 * row, "<i8", 2)).tolist()
        return a, np.frombuffer(self._ids.read_at(2 * (b - a), 2 * a), dtype="<u2")


def _key() -> Column:
    """The id as it stands in files; the number that stands for null is no id."""
    own = F.col("doc_id").cast("long")
    free = F.when(own == NULL_KEY, F.raise_error(F.lit(f"{NULL_KEY} stands for a null id"))).otherwise(own)
    return F.coalesce(free, F.lit(NULL_KEY)).alias("key")


_MANIFEST = "name string, rows long, ids long, least long, greatest long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, style: str, end_id: int) -> DataFrame:
    """Writes shards in ascending ``doc_id`` order under ``path``; returns the manifest, a written table.

    One range shuffle orders the texts, and rows with one id may part between
    shards, so no key is too frequent.  Each task encodes its range, appends
    ``end_id`` to each document, and writes a shard.  A shard's ``start`` in the
    manifest is the number of ids in the shards before it.  Null texts count as
    empty; a null id counts as less than any other, and an id of -2^63, which stands
    for it, is refused.  Repeated ids are stored each.  Other columns are ignored.
    Beyond ``MAX_SHARDS`` times ``SHARD_BYTES`` (2.4 TB) of text shards grow with it:
    the manifest goes to the driver, a row a shard.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id is a whole number; map other ids to numbers first")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(-(-size // SHARD_BYTES), MAX_SHARDS))
    rows = docs.select(_key(), "text")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, style)
        end = np.array([end_id], dtype="<u2").tobytes()
        shard = None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for i in range(0, len(keys), _TEXTS):
                shard = shard or ShardWriter(path)
                packed = coder.encode(batch.column("text").slice(i, _TEXTS).to_pylist())
                for key, ids in zip(keys[i : i + _TEXTS], packed):
                    shard.add(key, ids + end)
        if shard:
            columns = [pa.array([x]) for x in shard.close()]
            yield pa.RecordBatch.from_arrays(columns, ["name", "rows", "ids", "least", "greatest"])

    found = materialize(rows.mapInArrow(write, _MANIFEST), "written")
    # One row a shard; ranges of shards don't overlap but for a key that they share.
    before = "sum(ids) OVER (ORDER BY least, greatest, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return materialize(found.selectExpr("*", f"coalesce({before}, 0L) AS start"), "manifest")


def look_up(keys: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Per key in ``doc_id`` and stored row of it: doc_id, start, n_tokens, ids_crc32, read from the files.

    Keys go to the shards whose range has them and are looked up there; different
    keys are looked up once each.
    """
    wanted = keys.select(_key()).distinct()
    shards = manifest.orderBy("least", "greatest", "name").limit(2 * MAX_SHARDS).toPandas()
    known = keys.sparkSession.sparkContext.broadcast([shards[c].to_numpy() for c in ("name", "start", "least", "greatest")])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, least, greatest = known.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            first, end = np.searchsorted(greatest, key, "left"), np.searchsorted(least, key, "right")
            n = np.maximum(end - first, 0)
            of = np.repeat(np.arange(len(key)), n)
            shard = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            columns = [pa.array(names[shard], pa.string()), pa.array(starts[shard], pa.int64()), pa.array(key[of])]
            yield pa.RecordBatch.from_arrays(columns, ["name", "start", "key"])

    routed = wanted.mapInArrow(route, "name string, start long, key long")
    routed = routed.repartition("name").sortWithinPartitions("name", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            names = batch.column("name").to_pylist()
            starts = batch.column("start").to_pylist()
            all_keys = batch.column("key").to_numpy()
            bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if names[a] != name:
                    name, shard = names[a], ShardReader(path, names[a])
                out = []
                for key, rows in zip(all_keys[a:b].tolist(), shard.rows(all_keys[a:b])):
                    for row in rows:
                        at, ids = shard.ids(row)
                        out.append((None if key == NULL_KEY else key, starts[a] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return routed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written and, key by key, read back."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    manifest = write_token_files(docs.select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), "byte", 0)
    return look_up(docs.select("doc_id"), manifest, path)
