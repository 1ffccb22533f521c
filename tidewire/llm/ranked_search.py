"""Ranked lexical search of all documents for each query item: a threshold-seeded join.

Items are taken in blocks of bounded text, whose terms are broadcast; each block meets
all documents:

1. Documents become rows of an index: length, and which of the block's terms they hold
   how often.  It is written once and read by the steps below.
2. Each term's document frequency, greatest impact and ``k``-th greatest impact are
   counted over all documents and stored.
3. An item's ``k``-th score is at least the ``k``-th impact of any of its terms: that
   many documents reach it by the term alone.  So each item has a threshold before a
   document is scored.
4. Terms by falling greatest impact: where those from some place on cannot reach the
   threshold even together, a document that holds only such terms cannot either.  The
   terms before that place are the essential ones and alone make candidates; what
   they add up to, and the bound of the others, drops more of them.
5. Candidates are scored exactly with all terms.  A task keeps the best ``k`` of each
   item, and its own ``k``-th score raises the threshold; the best of all tasks are
   then ranked together.

Documents equal to a threshold stay, as ties are settled by id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read_table

#: Documents returned for an item; bytes of items' text to a block; rows of the index that are scored at once.
TOP_K, BLOCK_BYTES, ROWS = 20, 4 << 20, 4096
#: Fixed values of the score: of one term, ``SCALE * tf div (1000 * tf + K1 * m)``, where ``m`` is 75 and 25 times the relative length.
SCALE, TF, K1, SHORT, LENGTH = 1_000_000_000, 1_000, 12, 75, 25
#: Bytes to lower-case, and to blanks where they part terms: of ASCII only digits and letters are in terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Block:
    """Some items: their ids, the numbers of the block's terms, and each item's terms with how often it has them."""

    ids: list
    numbers: dict[bytes, int]
    terms: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        numbers: dict[bytes, int] = {}
        terms = [[(numbers.setdefault(t, len(numbers)), n) for t, n in Counter(terms_of(text)).items()] for _, text in rows]
        return cls([i for i, _ in rows], numbers, terms)


def index_documents(docs: DataFrame, doc_id: str, text: str, block: Block) -> DataFrame:
    """Of each document with terms: id, length ``n``, and the block's terms in it (``terms``, ascending) with frequencies ``tfs``."""
    numbers = docs.sparkSession.sparkContext.broadcast(block.numbers)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in batches:
            kept, lengths, terms, tfs = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                found = terms_of(t.as_py())
                if found:
                    counts = Counter(map(number, found))
                    counts.pop(None, None)
                    known = sorted(counts)
                    kept.append(i)
                    lengths.append(len(found))
                    terms.append(known)
                    tfs.append([counts[k] for k in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(index, f"_id {rows.schema['_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<bigint>")


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return SHORT + (LENGTH * n * docs) // total


@dataclass
class Postings:
    """Rows of the index by term: of term ``t``, rows and impacts from ``starts[t]`` to ``starts[t + 1]``."""

    starts: np.ndarray
    rows: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray, docs: int, total: int, size: int) -> Postings:
        """Impacts without a term's weight, which is the same for all its documents."""
        number, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
        impact = (SCALE * tf) // (TF * tf + K1 * norms(n, docs, total)[row])
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(size + 1))
        return cls(starts, row[order], impact[order])

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.rows[at], self.impacts[at]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def term_impacts(index: DataFrame, docs: int, total: int, size: int, k: int = TOP_K) -> DataFrame:
    """Of each term: ``df``, and its ``k`` greatest impacts without its weight, falling (``best``); exact over all documents.

    Tasks keep the best of each term.  They are merged in two steps, first by term
    and task, so that a term of all tasks is no large group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        best: dict[int, np.ndarray] = {}
        for batch in _pieces(batches):
            p = Postings.of(batch.column("n").to_numpy(), batch.column("terms"), batch.column("tfs"), docs, total, size)
            here = np.diff(p.starts)
            df += here
            for t in np.flatnonzero(here).tolist():
                mine = np.concatenate([best[t], p[t][1]]) if t in best else p[t][1]
                best[t] = -np.sort(-mine)[:k] if len(mine) > k else mine
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(df[found]), pa.array([best[t].tolist() for t in found.tolist()], pa.list_(pa.int64()))], ["term", "df", "best"]
        )

    parts = index.mapInArrow(count, "term int, df long, best array<bigint>").withColumn("_salt", F.spark_partition_id() % 64)

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k)
        return rows.groupBy(*by).agg(F.sum("df").alias("df"), best.alias("best"))

    return merged(merged(parts, "term", "_salt"), "term")


@dataclass
class Plan:
    """What scoring needs of a block: weights by term, and of each item the threshold, essential terms, others, and what those reach at most."""

    weights: np.ndarray
    thresholds: list[int]
    essential: list[list[tuple[int, int]]]
    others: list[list[tuple[int, int]]]
    rest: list[int]


def plan(block: Block, df: np.ndarray, greatest: np.ndarray, kth: np.ndarray, docs: int) -> Plan:
    """Thresholds from the stored ``k``-th impacts, and essential terms by suffix bounds; impacts are given without weights."""
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    greatest, kth = greatest * weights, kth * weights
    out = Plan(weights, [], [], [], [])
    for terms in block.terms:
        useful = sorted(((int(greatest[t]) * q, t, q) for t, q in terms if greatest[t] > 0), reverse=True)
        threshold = max((int(kth[t]) * q for _, t, q in useful), default=0)
        cut, rest = len(useful), 0
        while cut and rest + useful[cut - 1][0] < threshold:
            cut -= 1
            rest += useful[cut][0]
        out.thresholds.append(threshold)
        out.essential.append([(t, q) for _, t, q in useful[:cut]])
        out.others.append([(t, q) for _, t, q in useful[cut:]])
        out.rest.append(rest)
    return out


def score_candidates(index: DataFrame, p: Plan, docs: int, total: int, k: int = TOP_K) -> DataFrame:
    """(``item``: its number in the block, ``_id``, ``score``): of each task, each item's best documents with a score above 0."""
    held = index.sparkSession.sparkContext.broadcast(p)
    kind = index.schema["_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, arrow = held.value, None
        thresholds = list(p.thresholds)
        # Of each item a heap of (score, reversed order of ids, id); its least is the first to go.
        best: dict[int, list] = {}
        for batch in _pieces(batches):
            arrow = batch.schema.field("_id").type
            post = Postings.of(batch.column("n").to_numpy(), batch.column("terms"), batch.column("tfs"), docs, total, len(p.weights))
            ids = batch.column("_id")
            for item, essential in enumerate(p.essential):
                scores = np.zeros(batch.num_rows, dtype=np.int64)
                for t, q in essential:
                    rows, impacts = post[t]
                    scores[rows] += impacts * (p.weights[t] * q)
                rest = p.rest[item]
                least = max(thresholds[item], 1)
                able = np.flatnonzero((scores > 0) & (scores + rest >= least))
                if not len(able):
                    continue
                for t, q in p.others[item]:
                    rows, impacts = post[t]
                    scores[rows] += impacts * (p.weights[t] * q)
                able = able[scores[able] >= least]
                heap = best.setdefault(item, [])
                for i in able[np.argsort(-scores[able], kind="stable")].tolist():
                    s = int(scores[i])
                    if len(heap) >= k and s < heap[0][0]:
                        break
                    entry = (s, _Reversed(ids[i].as_py()))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                if len(heap) >= k:
                    thresholds[item] = max(thresholds[item], heap[0][0])
        found = [(item, e[1].value, e[0]) for item, heap in best.items() for e in heap]
        if found:
            items, values, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(values, arrow), pa.array(scores, pa.int64())], ["item", "_id", "score"])

    return index.mapInArrow(score, f"item int, _id {kind}, score long")


class _Reversed:
    """An id that counts as less than those that rank before it: than lower ids, and than null."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Reversed) -> bool:
        if self.value is None or other.value is None:
            return self.value is not None and other.value is None
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and self.value == other.value


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of about so many bytes of text, dealt by a hash."""
    rows = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = F.pmod(F.xxhash64("_item", "_text"), F.lit(n))
    for i in range(n):
        yield Block.of([tuple(r) for r in (rows.where(dealt == i) if n > 1 else rows).collect()])


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = TOP_K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Equal scores are ranked by ascending id, null first.  Null and empty texts have
    no terms: such documents are none of those counted, such items find nothing.
    Repeated rows are documents, or items, of their own; very long texts are read
    whole.  Empty tables give an empty one.  Other columns are not read.
    """
    spark = docs.sparkSession
    found: DataFrame | None = None
    for number, block in enumerate(_blocks(items, item_id, text, block_bytes)):
        index = materialize(index_documents(docs, doc_id, text, block), "index")
        n_docs, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = len(block.numbers)
        df, greatest, kth = (np.zeros(size, dtype=np.int64) for _ in range(3))
        if n_docs and size:
            for r in materialize(term_impacts(index, n_docs, total, size, k), "impacts").toLocalIterator():
                df[r.term], greatest[r.term], kth[r.term] = r.df, r.best[0], r.best[k - 1] if len(r.best) >= k else 0
        scored = score_candidates(index, plan(block, df, greatest, kth, n_docs), n_docs, total, k)
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("_id"))
        ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"item int, _item {items.schema[item_id].dataType.simpleString()}")
        ranked = ranked.join(F.broadcast(ids), "item").select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(doc_id), "score")
        if found is None:
            found = ranked
        else:
            found = materialize(found, f"found-{number}").union(ranked)
    return found


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def terms(table: str, key: str) -> str:
        return rf"""SELECT rid, {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM (SELECT row_number() OVER () AS rid, * FROM {table})"""

    return f"""WITH dt AS MATERIALIZED (SELECT rid, doc_id, t, count(*) AS tf FROM ({terms("documents", "doc_id")}) GROUP BY ALL),
    dn AS MATERIALIZED (SELECT rid, sum(tf)::BIGINT AS n FROM dt GROUP BY rid),
    tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM dn),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM dt, tot GROUP BY t),
    imp AS MATERIALIZED (SELECT rid, doc_id, t, w * (({SCALE} * tf) // ({TF} * tf + {K1} * ({SHORT} + ({LENGTH} * n * nd) // l))) AS i FROM dt JOIN dn USING (rid) JOIN w USING (t), tot),
    it AS (SELECT rid AS irid, item_id, t, count(*) AS q FROM ({terms("benchmark", "item_id")}) GROUP BY ALL),
    s AS (SELECT irid, item_id, rid, doc_id, sum(q * i)::BIGINT AS score FROM it JOIN imp USING (t) GROUP BY ALL HAVING sum(q * i) > 0)
    SELECT item_id, (row_number() OVER (PARTITION BY irid ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM s QUALIFY rank <= {TOP_K}"""
