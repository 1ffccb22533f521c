"""Packing documents into fixed windows by lexical retrieval.

Documents are first ordered by what they say: a tree of two-way splits, grown from
a bounded sample of term vectors, gives each document a leaf, and the table is
ranged by leaf and rarest shared ids.  Index shards are cut from that order, so
that a shard holds documents on like matters wherever their files have them.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import give_back, materialize, read_table
from tidewire.llm.tokenization import encoder, vocabulary

#: Ids of a sequence.
SEQUENCE = 4096
#: Ends each document.
END_ID = 2
#: Ids of an index shard, about: its documents are packed with each other.
SHARD_TOKENS = 1_500_000
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Numbers of a term vector, sampled vectors that the tree is grown from, and the fewest of them in a split.
VECTOR, TREE_SAMPLE, LEAST_SPLIT = 64, 16_384, 8
#: Share of a shard that a range holds on average, so that few ranges outgrow a shard.
RANGE_SHARE = 0.8
#: Texts encoded at once.
_TEXTS = 2048
VOCABULARY = 1 << 16


_PROJECTION: list[np.ndarray] = []


def projection() -> np.ndarray:
    """A fixed random vector for each id: vectors of documents keep the cosines of their weighted terms, nearly."""
    if not _PROJECTION:
        _PROJECTION.append(np.random.default_rng(7).standard_normal((VOCABULARY, VECTOR), dtype=np.float32))
    return _PROJECTION[0]


def describe(docs: list[np.ndarray], idf: np.ndarray, mean_tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each document its term vector, of length 1 (0 if it shares no id), and its two rarest shared ids as one number."""
    vectors = np.zeros((len(docs), VECTOR), dtype=np.float32)
    rare = np.zeros(len(docs), dtype=np.int64)
    for i, doc in enumerate(docs):
        # Stable sorting of 16-bit numbers goes digit by digit, faster than np.unique.
        ids = np.sort(doc, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        ids, tf = ids[starts], np.diff(starts, append=len(ids)).astype(np.float32)
        own = idf[ids].astype(np.float32)
        if not own.any():
            continue
        weight = own * tf * (K1 + 1) / (tf + np.float32(K1 * (1 - B + B * len(doc) / max(mean_tokens, 1.0))))
        v = weight @ projection()[ids]
        vectors[i] = v / max(float(np.linalg.norm(v)), 1e-9)
        first = int(np.argmax(own))
        own[first] = 0
        rare[i] = int(ids[first]) << 16 | int(ids[int(np.argmax(own))])
    return vectors, rare


class Tree:
    """Two-way splits of vectors; leaves are numbered so that those of one branch follow each other."""

    def __init__(self, sample: np.ndarray):
        self.normals, self.bounds, self.children = [], [], []
        self.leaves = 0
        self._root = self._grow(sample.astype(np.float32))
        self.normals = np.array(self.normals, dtype=np.float32).reshape(-1, VECTOR)
        self.bounds = np.array(self.bounds, dtype=np.float32)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray) -> int:
        """A node's number, or a leaf's below 0; a split is that of 2-means from two vectors far from each other."""
        if len(x) < LEAST_SPLIT:
            return self._leaf()
        a = x[int(np.argmin(x @ x.mean(axis=0)))]
        b = x[int(np.argmin(x @ a))]
        for _ in range(6):
            normal, bound = a - b, float((a @ a - b @ b) / 2)
            side = x @ normal > bound
            if side.all() or not side.any():
                return self._leaf()
            a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
        at = len(self.bounds)
        self.normals.append(normal)
        self.bounds.append(bound)
        self.children.append((0, 0))
        self.children[at] = (self._grow(x[~side]), self._grow(x[side]))
        return at

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self._root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (vectors[inner] * self.normals[node]).sum(axis=1) > self.bounds[node]
            at[inner] = self.children[node, side.astype(np.int64)]
        return -at


class Shard:
    """A BM25 inverted index over the documents of a shard, and which of them are unused.

    Postings of ids that a quarter of the documents have are rows of a dense matrix,
    all others lists; both are cut down to the unused documents as these get fewer.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_tokens: float):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        flat = np.concatenate(docs).astype(np.int64) if n else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), sizes)
        useful = idf[flat] > 0
        pairs, tf = np.unique(flat[useful] * n + owner[useful], return_counts=True)
        doc = pairs % max(n, 1)
        ids = pairs // max(n, 1)
        norm = K1 * (1 - B + B * sizes / max(mean_tokens, 1.0))
        weight = (idf[ids] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        often = np.bincount(ids, minlength=VOCABULARY) * 4 > n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        in_row = often[ids]
        self.dense = np.zeros((int(often.sum()), n), dtype=np.float32)
        self.dense[self.row[ids[in_row]], doc[in_row]] = weight[in_row]
        self.doc, self.weight = doc[~in_row], weight[~in_row]
        self.starts = np.searchsorted(ids[~in_row], np.arange(VOCABULARY + 1))
        self.idf = idf
        self.docs = docs
        self.unused = np.ones(n, dtype=bool)
        #: The documents that have a column.
        self.held = np.arange(n)

    def _drop_used(self) -> None:
        """Leaves columns and postings of unused documents only."""
        keep = self.unused[self.held]
        column = np.cumsum(keep) - 1
        stays = keep[self.doc]
        self.starts = np.concatenate([[0], np.cumsum(stays)])[self.starts]
        self.doc, self.weight = column[self.doc[stays]], self.weight[stays]
        self.dense, self.held = np.ascontiguousarray(self.dense[:, keep]), self.held[keep]

    def neighbours(self, seed: int, needed: int) -> list[int]:
        """Unused documents by descending score for the seed, until they have ``needed`` ids; a tie goes to the earlier."""
        if 4 * int(self.unused.sum()) < 3 * len(self.held):
            self._drop_used()
        own = np.unique(self.docs[seed]).astype(np.int64)
        query = own[self.idf[own] > 0]
        rows = self.row[query]
        score = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        # The other ids' runs of postings one after another.
        first = self.starts[query]
        n = self.starts[query + 1] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        score += np.bincount(self.doc.take(at), weights=self.weight.take(at), minlength=len(score))
        score[~self.unused[self.held]] = 0
        found = np.flatnonzero(score > 0)
        best, total = [], 0
        for d in self.held[found[np.argsort(-score[found], kind="stable")]].tolist():
            best.append(d)
            total += len(self.docs[d])
            if total >= needed:
                break
        return best


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_tokens: float, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset).

    A sequence is filled by what is left of the last document, or else the next
    unused document as seed, then by the seed's unused neighbours, best first;
    the last is cut and its rest begins the next sequence.  Without neighbours
    left, the next unused document fills on.  Only the shard's last sequence can
    be short.
    """
    shard = Shard(docs, idf, mean_tokens)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = next_ = 0
    queue: list[int] = []
    seed = None
    while True:
        while queue and not shard.unused[queue[0]]:
            queue.pop(0)
        if queue:
            doc = queue.pop(0)
        else:
            while next_ < len(docs) and not shard.unused[next_]:
                next_ += 1
            if next_ == len(docs):
                return pieces
            doc = next_
            seed = None
        shard.unused[doc] = False
        at, n = 0, len(docs[doc])
        while at < n:
            length = min(n - at, size - offset)
            pieces.append((doc, at, length, sequence, offset))
            at += length
            offset += length
            if offset == size:
                sequence, offset, seed, queue = sequence + 1, 0, None, []
                if at < n:
                    seed = doc
        if offset and seed is None or offset and not queue:
            seed = doc if seed is None else seed
            queue = shard.neighbours(seed, size - offset)


@dataclass
class Encoded:
    """A written table of ``doc_id`` and ``ids`` (16-bit little-endian, with the end id), and what was counted as it was written."""

    rows: DataFrame
    n_docs: int
    n_ids: int
    #: In how many documents each id of the vocabulary stands.
    frequencies: np.ndarray


def encode_documents(docs: DataFrame, tokenizer: str) -> Encoded:
    """Encodes all texts once; null texts count as empty.

    Each task also counts its documents by id, and writes the counts as one more row,
    so that neither texts nor ids are read again for them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "counts", "n_docs", "n_ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u2").tobytes()
        coder = encoder(tokenizer, "word")
        counts = np.zeros(VOCABULARY, dtype="<u4")
        n_docs = n_ids = 0
        key_type = None

        def row(keys: pa.Array, packed: pa.Array, counts_: bytes | None, n: int | None, ids: int | None) -> pa.RecordBatch:
            more = [pa.array([x] * len(keys), t) for x, t in ((counts_, pa.binary()), (n, pa.int64()), (ids, pa.int64()))]
            return pa.RecordBatch.from_arrays([keys, packed, *more], names)

        for batch in batches:
            key_type = batch.column("doc_id").type
            for i in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(i, _TEXTS)
                packed = [ids + end for ids in coder.encode(part.column("text").to_pylist())]
                for ids in packed:
                    own = np.sort(np.frombuffer(ids, dtype="<u2"), kind="stable")
                    counts[own[np.append(True, own[1:] != own[:-1])]] += 1
                    n_ids += len(own)
                n_docs += len(packed)
                yield row(part.column("doc_id"), pa.array(packed, pa.binary()), None, None, None)
        give_back()
        if n_docs:
            yield row(pa.array([None], key_type), pa.array([None], pa.binary()), counts.tobytes(), n_docs, n_ids)

    ddl = f"doc_id {kind}, ids binary, counts binary, n_docs long, n_ids long"
    written = materialize(docs.select("doc_id", "text").mapInArrow(encode, ddl), "ids")
    told = written.where("counts IS NOT NULL")
    total = told.agg(F.sum("n_docs"), F.sum("n_ids")).first()
    return Encoded(written.where("counts IS NULL").select("doc_id", "ids"), total[0] or 0, total[1] or 0, _summed(told.select("counts")))


def _summed(told: DataFrame) -> np.ndarray:
    """One number for each id of the vocabulary, whatever the input; tasks add up what they read before it is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), dtype="<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = told.mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, dtype=np.int64)
    out[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's weight of each id; 0 for the end id and for ids of fewer than two documents, which lead to no other."""
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    idf[(df < 2) | (np.arange(VOCABULARY) == END_ID)] = 0
    return idf


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(ids.as_py(), dtype="<u2") for ids in column]


def order_documents(encoded: DataFrame, n_docs: int, known, ranges: int) -> DataFrame:
    """Documents ranged by the tree's leaves, then by rarest shared ids; ``known`` is a broadcast of weights and mean length.

    Ranges are bounded from the sample too, to hold as many ids each.  Equal
    documents are told apart by their place in the table, so a group of copies of
    any size is cut like all others.
    """
    spark = encoded.sparkSession
    kind = encoded.schema["doc_id"].dataType.simpleString()
    encoded = encoded.withColumn("place", F.monotonically_increasing_id())

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = _arrays(batch.column("ids"))
            vectors, rare = describe(docs, *known.value)
            columns = [pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(rare), batch.column("place"), pa.array([len(d) for d in docs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["v", "rare", "place", "n"])

    part = encoded.select("ids", "place").sample(False, min(1.0, TREE_SAMPLE / max(n_docs, 1)), 11)
    found = part.mapInArrow(sampled, "v binary, rare long, place long, n long").toPandas().sort_values("place")
    sample = np.frombuffer(b"".join(map(bytes, found["v"])), dtype=np.float32).reshape(-1, VECTOR)
    tree = Tree(sample)
    keys = sorted(zip(tree.leaf_of(sample).tolist(), found["rare"].tolist(), found["place"].tolist(), found["n"].tolist()))
    share = (np.cumsum([k[3] for k in keys]) - 1) * ranges // max(1, sum(k[3] for k in keys))
    bounds = [keys[i][:3] for i in np.flatnonzero(np.diff(share)).tolist()]
    shape = spark.sparkContext.broadcast((tree, bounds))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bounds = shape.value
        for batch in batches:
            for i in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(i, _TEXTS)
                vectors, rare = describe(_arrays(part.column("ids")), *known.value)
                leaf = tree.leaf_of(vectors)
                range_ = [bisect.bisect_left(bounds, k) for k in zip(leaf.tolist(), rare.tolist(), part.column("place").to_pylist())]
                columns = [part.column("doc_id"), part.column("ids"), part.column("place"), pa.array(leaf), pa.array(rare), pa.array(range_, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "place", "leaf", "rare", "range"])

    located = encoded.mapInArrow(locate, f"doc_id {kind}, ids binary, place long, leaf long, rare long, range int")
    return located.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("leaf", "rare", "place")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids.

    Texts are encoded once into a written table.  Frequencies of ids over all
    documents weigh the terms.  The table is ordered by content (see
    ``order_documents``), and index shards are cut from that order as it is read;
    a shard holds a bounded number of ids (one longer document makes a shard of
    its own).  Within a shard all ids of a seed that another document has make its
    query; documents of other shards are not returned.  Null and empty texts are
    documents of the end id alone; repeated rows are packed each; an empty table
    gives no pieces.  Other columns are ignored.
    """
    encoded = encode_documents(docs, tokenizer)
    idf = weights(encoded.frequencies, encoded.n_docs)
    known = docs.sparkSession.sparkContext.broadcast((idf, encoded.n_ids / max(encoded.n_docs, 1)))
    ordered = order_documents(encoded.rows, encoded.n_docs, known, max(1, math.ceil(encoded.n_ids / (RANGE_SHARE * shard_tokens))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = known.value
        first: int | None = None
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pack_shard(held, idf, mean, size)
            for i in range(0, len(pieces), 2000):
                rows = []
                for doc, start, length, sequence, offset in pieces[i : i + 2000]:
                    ids = held[doc][start : start + length]
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((keys[doc], start, length, crc, len(held[doc]), first + sequence, offset, ids.tobytes()))
                columns = [*zip(*rows)]
                types = [key_type, *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            first += pieces[-1][3] + 1
            keys.clear()
            held.clear()

        for batch in batches:
            key_type = batch.column("doc_id").type
            if first is None and batch.num_rows:
                first = batch.column("part")[0].as_py() << 40
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                keys.append(key)
                held.append(np.frombuffer(ids.as_py(), dtype="<u2"))
                tokens += len(held[-1])
                if tokens >= shard_tokens:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    placed = ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part"))
    return placed.mapInArrow(
        pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary("word_bpe_49k.json")).drop("ids")
