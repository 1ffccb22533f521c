"""Benchmark decontamination: word windows of documents against a hash set of benchmark windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import give_back, materialize, put_aside, read_table

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text to an index, about, which the driver builds and executors hold.  A larger
#: benchmark is cut into blocks, scanned one after another; a longer item is cut into pieces that overlap by a
#: window.  An index of 8 MB of text was measured at 35 MB as sent to executors, and 154 MB more memory of the driver.
BLOCK_BYTES = 8 << 20
#: Words of documents looked up at once.
CHUNK_WORDS = 400_000

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Maps A-Z to a-z and whatever is in no word to a space; in UTF-8, bytes from 0x80 on are parts of letters.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256)
)
_WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` word numbers."""
    n = max(0, len(ids) - length + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class _Table:
    """Different windows of one length, by hash: where each stands in the index's words, and the items that have it, from ``bounds`` on."""

    length: int
    hashes: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray


class WindowIndex:
    """The windows of benchmark items, as arrays: words by number, and by length of window their hashes, places and items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        texts = [(str(item_id), words_of(text)) for item_id, text in items if item_id is not None]
        texts = [(item_id, words) for item_id, words in texts if words]
        self.names = sorted({item_id for item_id, _ in texts})
        number = {item_id: i for i, item_id in enumerate(self.names)}
        #: Benchmark word to its number from 1 on; any other word is 0.
        self.vocabulary: dict[bytes, int] = {}
        sizes = np.array([len(words) for _, words in texts], dtype=np.int64)
        flat = (self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for _, words in texts for w in words)
        self.words = np.fromiter(flat, dtype=np.int32, count=int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        owner = np.array([number[item_id] for item_id, _ in texts], dtype=np.int32)
        lengths = np.minimum(sizes, window)
        self.tables = [self._table(n, firsts, sizes, owner, lengths == n) for n in np.unique(lengths).tolist()]

    def _table(self, length: int, firsts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, here: np.ndarray) -> _Table:
        firsts, n, owner = firsts[here], sizes[here] - length + 1, owner[here]
        starts = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owners = np.repeat(owner, n)
        hashes = _hashes(self.words, length)[starts]
        order = np.lexsort((owners, hashes))
        hashes, starts, owners = hashes[order], starts[order].astype(np.int32), owners[order]
        # Equal hashes are equal windows but for a collision; then each is a window of its own.
        fresh = np.append(True, hashes[1:] != hashes[:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        span, unlike = np.arange(length), [np.empty(0, np.int64)]
        for at in range(0, len(starts), 1 << 16):
            part = slice(at, at + (1 << 16))
            same = (self.words[starts[part, None] + span] == self.words[starts[head[part], None] + span]).all(axis=1)
            unlike.append(head[part][~same])
        fresh |= np.isin(head, np.concatenate(unlike))
        first = np.flatnonzero(fresh)
        return _Table(length, hashes[first], starts[first], np.append(first, len(starts)), owners)

    def find(self, ids: np.ndarray) -> Iterator[tuple[_Table, np.ndarray, np.ndarray]]:
        """By length: places where a window stands, and its number in the table.

        A hash only proposes; the words decide.  Windows with equal hashes are all compared.
        """
        for t in self.tables:
            h = _hashes(ids, t.length)
            if not len(h):
                continue
            at = np.searchsorted(t.hashes, h)
            ahead = 0
            while True:
                row = at + ahead
                same = (row < len(t.hashes)) & (t.hashes[np.minimum(row, len(t.hashes) - 1)] == h)
                places = np.flatnonzero(same)
                if not len(places):
                    break
                rows = row[places]
                span = np.arange(t.length)
                real = np.all(ids[places[:, None] + span] == self.words[t.starts[rows, None] + span], axis=1)
                yield t, places[real], rows[real]
                ahead += 1


def _scan_chunk(index: WindowIndex, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document its hit (start, length) pairs in words and the items found."""
    sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # One word number 0, which no window has, stands behind each document.
    flat = chain.from_iterable(chain(d, (b"",)) for d in docs)
    known = index.vocabulary.get
    ids = np.fromiter((known(w, 0) for w in flat), dtype=np.int32, count=int(starts[-1]))
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
    for t, places, rows in index.find(ids):
        of = np.searchsorted(starts, places, side="right") - 1
        for doc, place, row in zip(of.tolist(), (places - starts[of]).tolist(), rows.tolist()):
            out[doc][0].append((place, t.length))
            # Most windows of a passage have the same items as the one before.
            out[doc][1].update(index.names[i] for i in t.owners[t.bounds[row] : t.bounds[row + 1]].tolist())
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans joined, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words, and without what stands between the words of a span."""
    places = [m.span() for m in _WORD_CHARS.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


_ADDED = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>"


def _pieces(item_id: object, text: str, limit: int) -> Iterator[tuple[object, str]]:
    """An item, cut into pieces of words of about ``limit`` bytes if it is longer; neighbours share all but one word of a window."""
    words = words_of(text)
    if len(words) <= WINDOW or len(text) <= limit:
        yield item_id, text
        return
    start = 0
    while start + WINDOW - 1 < len(words):
        end, size = start, 0
        while end < len(words) and (size + len(words[end]) < limit or end - start < WINDOW):
            size += len(words[end]) + 1
            end += 1
        yield item_id, b" ".join(words[start:end]).decode("utf-8", "surrogatepass")
        start = end - WINDOW + 1


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[WindowIndex]:
    """Indexes of about ``block_bytes`` of text each, one after another; the driver holds one, and the rows that it reads for it."""
    rows = benchmark.where("item_id IS NOT NULL").select("item_id", "text").toLocalIterator(prefetchPartitions=False)
    held: list[tuple[object, str]] = []
    size = 0
    for row in rows:
        for item_id, text in _pieces(row[0], row[1] or "", block_bytes):
            if held and size + len(text) > block_bytes:
                yield WindowIndex(held)
                held, size = [], 0
            held.append((item_id, text))
            size += len(text)
    if held:
        yield WindowIndex(held)


#: Columns that ``mark_hits`` adds; a caller's columns of these names are kept under names of ours meanwhile.
ADDED = ("n_words", "hit_spans", "item_ids")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan_with(index_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds an index's hits to those of the indexes before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            n_words, spans, items = [], [], []
            chunk: list[list[bytes]] = []
            size = 0

            def flush():
                for found, of in _scan_chunk(index, chunk):
                    spans.append([(a, a + n) for a, n in found])
                    items.append(of)
                chunk.clear()

            for text in batch.column("text"):
                words = words_of(text.as_py())
                n_words.append(len(words))
                chunk.append(words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    flush()
                    size = 0
            flush()
            before, had = batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist()
            all_spans = [
                [{"start": a, "end": b} for a, b in merged([*((s["start"], s["end"]) for s in old), *new])]
                for old, new in zip(before, spans)
            ]
            all_items = [sorted({*old, *new}) for old, new in zip(had, items)]
            own = [c for c in batch.schema.names if c not in ADDED]
            added = (pa.array(n_words, pa.int64()), pa.array(all_spans, _SPANS), pa.array(all_items, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *added], [*own, *ADDED])
        give_back()

    return scan


def mark_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (merged, in words, end exclusive) and ``item_ids`` to documents with a ``text``.

    Documents are neither shuffled nor joined: an index of a block of the benchmark
    is broadcast (its size is bounded by ``block_bytes``, whatever the benchmark's)
    and scanned over all documents.  Of several blocks each scan but the last is
    written, so that the driver and each executor hold one index at a time.  Null
    and empty texts have no words.  An empty benchmark hits nothing.  Columns of
    ``docs`` by the added names are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ADDED]
    marked = docs.select(
        *own,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    known = None
    for index in chain(_blocks(benchmark, block_bytes), (None,)):
        if index is None and known is not None:
            break
        if known is not None:
            marked = materialize(marked, "scanned")
            known.unpersist()
        known = spark.sparkContext.broadcast(index or WindowIndex([]))
        marked = marked.mapInArrow(_scan_with(known), ddl)
    return marked


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def is_contaminated() -> Column:
    """Of 20 words, one or more hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names."""
    docs, own = put_aside(docs, ADDED)
    return mark_hits(docs, benchmark).where(~is_contaminated()).select(*own)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with hit spans cut out of their texts."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans)
        return pd.Series([without_words(t, [(s["start"], s["end"]) for s in hit]) if t and len(hit) else t for t, hit in pairs], dtype=object)

    docs, own = put_aside(docs, ADDED)
    return mark_hits(docs, benchmark).withColumn("text", cut("text", "hit_spans")).select(*own)


def op2_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_hits(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op2_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: list_slice(w, i, i + n - 1))) AS x FROM bl),
bx AS (SELECT n, x, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM bw GROUP BY n, x),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n),
h AS (SELECT rid, i, p.n AS n, ids FROM p JOIN bx ON p.n = bx.n AND list_slice(p.w, i, i + p.n - 1) = x),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, unnest(ids) AS id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
