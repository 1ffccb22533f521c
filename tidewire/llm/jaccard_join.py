"""Exact Jaccard join of word shingle sets as a join in a metric space.

1 - Jaccard is a metric, so distances to pivots tell which documents cannot be
linked.  Documents without a common shingle have distance exactly 1 from each
other, for which no pivot document can tell them apart, so three exact steps come
before the pivots:

1. A linked set has all but a quarter of its shingles in common with one other
   set.  Over a fixed share of all shingles (those of small hash) it is counted
   how many of each set are in any other set; sets with too few are linked with
   nothing but equal sets.
2. The same over all shingles of the sets that are left.
3. Pivots of one shingle: a set lies in the regions of its rarest shingles, so many
   of them that two linked sets meet in one region for certain.  Regions that
   share sets join to one.

Within a region documents are the pivots: a region too large for one task is
divided into Voronoi cells, into which the triangle inequality copies the
documents near a border, again and again; the rest are joined in a task each,
pivot by pivot, comparing only what the distances to earlier pivots leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, give_back, materialize, put_aside, read_table, shuffle_partitions
from tidewire.llm.components import components

#: Words of a shingle.
SHINGLE = 5
#: A link needs 100 * common >= PERCENT * united.
PERCENT = 75
#: The same as a distance.
RADIUS = 1 - PERCENT / 100
#: Shingles of a region that one task joins (8 bytes each); larger regions are divided.
REGION_SHINGLES = 2_000_000
#: The share of all shingles that the first step looks at.
SHARE = 0.35
#: Pivots of a division, distances kept in a task's join, and divisions before a region is joined by blocks.
PIVOTS, KEPT_DISTANCES, DIVISIONS = 12, 32, 4
#: A division counts if its cells hold at most so many times the region, and the largest at most such a share of it.
REPLICATION, LARGEST_CELL = 2.0, 0.75
#: Pivots of all regions are broadcast up to so many bytes, else joined.
PIVOT_BYTES = 32 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(33))


#: Hashes of words kept by a task; frequent words come early.
MAX_WORDS = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text; of all its words if they are fewer; empty without words.

    Words are runs between white space; A-Z are lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = _mix(h, _A) + w[k : k + n]
    h = np.sort(_mix(h, _B))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, the first half not negative."""
    a = int(_mix(s, _A).sum(dtype=np.uint64)) & (2**63 - 1)
    b = int(_mix(s, _B).sum(dtype=np.uint64))
    return a, b - 2**64 if b >= 2**63 else b


def spare(n: int) -> int:
    """So many shingles of a set may be missing in a set linked with it."""
    return n - -(-PERCENT * n // 100)


_LIMIT = np.uint64(int(SHARE * 2**64))


def _hash_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, t (the text's hash), n (shingles), few (those of the share), a and b (the set's key)."""
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            rows.append((len(s), int(np.searchsorted(s, _LIMIT)), *set_key(s)))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *columns], ["doc_id", "t", "n", "few", "a", "b"])
    _HASHES.clear()
    give_back()


def _share_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's shingles of the share (s) with half its key (a); a set that a task has met before is left out."""
    seen: set[int] = set()
    parts: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(keys))], ["s", "a"])

    for batch in batches:
        for text in batch.column("text"):
            s = shingles(text.as_py())
            if len(s) < 2:  # linked with equal sets only
                continue
            key = set_key(s)[0]
            if key in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(key)
            s = s[: np.searchsorted(s, _LIMIT)]
            parts.append(s)
            keys.append(np.full(len(s), key, dtype=np.int64))
            held += len(s)
            if held > 300_000:
                yield out()
                parts.clear()
                keys.clear()
                held = 0
    if held:
        yield out()
    _HASHES.clear()
    give_back()


def _in_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by s and a: how many of each set's shingles (a, c) stand beside another set's; reads on, holds one row."""
    last: tuple[int, int] | None = None
    last_common = False

    def counted(a: np.ndarray) -> pa.RecordBatch:
        key, c = np.unique(a, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c.astype(np.int64))], ["a", "c"])

    for batch in batches:
        s, a = batch.column("s").to_numpy(), batch.column("a").to_numpy()
        if last is not None:
            s, a = np.append(last[0], s), np.append(last[1], a)
        if not len(s):
            continue
        own = np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1]))
        s, a = s[own], a[own]
        same = s[1:] == s[:-1]
        common = np.append(last_common if last is not None else False, same) | np.append(same, False)
        yield counted(a[:-1][common[:-1]])
        # Whether the last row has another beside it before; what comes after is seen in the next batch.
        last, last_common = (s[-1], a[-1]), bool(common[-1])
    if last is not None and last_common:
        yield counted(np.array([last[1]], dtype=np.int64))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
        parts = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column("s")]
        size = [len(x) for x in parts]
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), *(pa.array(np.repeat(x, size)) for x in (a, b, n))], ["s", "a", "b", "n"])


def _regions(members: DataFrame) -> DataFrame:
    """Steps 2 and 3 over ``members`` (a, b, n, s): (a, b, region) of the sets that may be linked with others."""
    rows = members.select("a", "b", "n", "s").mapInArrow(_flat, "s long, a long, b long, n long")
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = rows.join(often, "s")
    own = Window.partitionBy("a", "b")
    rows = rows.withColumn("c", F.count(F.lit(1)).over(own)).where(100 * F.col("c") >= PERCENT * F.col("n"))
    n, place = F.col("n"), F.row_number().over(own.orderBy("times", "s"))
    # Shingles found in this set alone come first in the order; they meet nothing, but count.
    rows = rows.withColumn("place", place + n - F.col("c"))
    rows = rows.where(F.col("place") <= n - F.ceil(n * PERCENT / 100) + 1)
    index = F.col("place") <= n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT)) + 1
    node = F.struct("a", "b")
    rows = materialize(rows.select("s", node.alias("node"), index.alias("index")), "offered")
    hubs = rows.where("index").groupBy("s").agg(F.min("node").alias("hub"))
    found = rows.join(hubs, "s").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    return components(found, "candidates").select("node.a", "node.b", F.concat_ws(".", "root.a", "root.b").alias("region"))


class Region:
    """Sets held by one task, with their common shingles numbered."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        self.shingle, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        common = counts[ids] > 1
        owner = np.repeat(np.arange(len(sets)), self.n)[common]
        self.ids = ids[common]
        self.ends = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.counts = counts
        sums = np.concatenate([[0], np.cumsum(counts[self.ids])])
        self.score = (sums[self.ends[1:]] - sums[self.ends[:-1]]) / np.maximum(self.n, 1)
        self.mark = np.zeros(len(self.shingle), dtype=bool)

    def distances(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """From set x to all: distances, and whether linked (in whole numbers)."""
        mine = self.ids[self.ends[x] : self.ends[x + 1]]
        self.mark[mine] = True
        sums = np.concatenate([[0], np.cumsum(self.mark[self.ids])])
        self.mark[mine] = False
        common = sums[self.ends[1:]] - sums[self.ends[:-1]]
        common[x] = self.n[x]
        united = self.n + self.n[x] - common
        return 1 - common / united, 100 * common >= PERCENT * united


def join_region(sets: list[np.ndarray]) -> np.ndarray:
    """The components of a region: for each set the place of a set that stands for its component.

    Sets become pivots in turn, those made of the region's commonest shingles
    first.  A pivot is compared with all sets unless the distances to earlier
    pivots differ by more than the radius, or sizes do, or they are in its
    component already, for every set not yet a pivot.
    """
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    region = Region(sets)
    open_ = np.ones(m, dtype=bool)
    kept = np.empty((KEPT_DISTANCES, m))
    n_kept = 0
    for x in np.argsort(-region.score, kind="stable").tolist():
        open_[x] = False
        maybe = open_ & (root != root[x])
        maybe &= (100 * region.n >= PERCENT * region.n[x]) & (100 * region.n[x] >= PERCENT * region.n)
        at = np.flatnonzero(maybe)
        if len(at) and n_kept:
            near = np.abs(kept[:n_kept, at] - kept[:n_kept, x, None]) <= RADIUS + 1e-9
            at = at[near.all(axis=0)]
        if not len(at):
            continue
        distance, linked = region.distances(x)
        if n_kept < KEPT_DISTANCES:
            kept[n_kept] = distance
            n_kept += 1
        roots = np.unique(root[linked])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def _join_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sets sorted by region: a link from the set that stands for a component to each other of it."""
    region, held = None, []

    def links(held: list[tuple]) -> list[tuple]:
        if len(held) < 2:
            return []
        root = join_region([h[2] for h in held])
        return [(*held[r][:2], *held[i][:2]) for i, r in enumerate(root.tolist()) if r != i]

    found: list[tuple] = []
    names = ["ua", "ub", "va", "vb"]

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("region", "a", "b"))
        for r, a, b, s in zip(*columns, batch.column("s")):
            if r != region:
                found += links(held)
                region, held = r, []
                if len(found) > 50_000:
                    yield out(found)
                    found = []
            if not held or held[-1][:2] != (a, b):
                held.append((a, b, np.frombuffer(s.as_buffer(), dtype=np.uint64)))
    found += links(held)
    if found:
        yield out(found)


_LINKS = "ua long, ub long, va long, vb long"


def _joined(members: DataFrame) -> DataFrame:
    rows = members.repartition(shuffle_partitions(members.sparkSession), "region").sortWithinPartitions("region", "a", "b")
    return rows.mapInArrow(_join_regions, _LINKS)


def _distances_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``d``: the distance of each member to each pivot of its region, in the order of ``pivots``."""
    for batch in batches:
        out = []
        for s, pivots in zip(batch.column("s"), batch.column("pivots")):
            mine = np.frombuffer(s.as_buffer(), dtype=np.uint64)
            row = []
            for p in pivots:
                theirs = np.frombuffer(p["s"].as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                united = len(mine) + len(theirs) - common
                row.append((1 - common / united, 100 * common >= PERCENT * united))
            out.append([{"d": d, "linked": x} for d, x in row])
        kind = pa.list_(pa.struct([("d", pa.float64()), ("linked", pa.bool_())]))
        names = [c for c in batch.schema.names if c not in ("pivots",)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, kind)], [*names, "d"])


def _divide(members: DataFrame, sizes: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Divides each region into cells: (links found with pivots, members of the cells, regions that pivots don't divide).

    A pivot's cell has the documents nearest to it and, as visitors, those whose
    distance to it is at most two radii more than to their own pivot: a linked
    pair of different cells meets in both.  Documents linked with the pivot are
    linked with each other through it; they stay only if some other document of
    the cell is within a radius of them by distances to the pivot.

    Where most documents are as far from one pivot as from another, nearly all would
    visit nearly every cell.  So cells are counted first, by distances alone, and a
    region whose cells come out too large or too many times over is left whole.
    """
    chance = F.lit(float(2 * PIVOTS)) / F.col("n_sets")
    picked = (
        members.join(sizes.select("region", "n_sets"), "region")
        .where(F.pmod(F.xxhash64("a", "b", F.lit(level)), F.lit(1_000_000)) < chance * 1_000_000)
        .groupBy("region")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("a", "b", "s"))), 1, PIVOTS).alias("pivots"))
    )
    picked = materialize(picked, "pivots")
    held = picked.agg(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["s"])))).first()[0]
    picked_side = F.broadcast(picked) if (held or 0) <= PIVOT_BYTES else picked
    rows = members.select("region", "a", "b", "n", "s").join(picked_side, "region", "left")
    rows = rows.withColumn("pivots", F.coalesce("pivots", F.array().cast(picked.schema["pivots"].dataType)))
    keys = rows.withColumn("pivot_keys", F.transform("pivots", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    measured = keys.mapInArrow(
        _distances_to,
        "region string, a long, b long, n long, s binary, pivot_keys array<struct<a:long,b:long>>, d array<struct<d:double,linked:boolean>>",
    )
    measured = materialize(measured, "distances")
    each = measured.select("region", "a", "b", F.posexplode(F.arrays_zip("pivot_keys", "d")).alias("cell", "x"))
    links = each.where("x.d.linked").selectExpr("x.pivot_keys.a AS ua", "x.pivot_keys.b AS ub", "a AS va", "b AS vb")
    own = F.array_min(F.transform("d", lambda x, i: F.struct(x["d"].alias("d"), i.alias("cell"), x["linked"].alias("linked"))))
    placed = measured.withColumn("own", own).select(
        "*", F.posexplode_outer("d").alias("cell", "to")
    ).where(F.col("cell").isNull() | (F.col("cell") == F.col("own.cell")) | (F.col("to.d") <= F.col("own.d") + 2 * RADIUS + 1e-9))
    placed = placed.select(
        F.col("region").alias("parent"),
        F.concat_ws("/", "region", F.coalesce(F.col("cell"), F.lit(-1))).alias("region"),
        "a", "b", "n", "s",
        F.coalesce("to.d", F.lit(1.0)).alias("d"),
        F.coalesce("to.linked", F.lit(False)).alias("settled"),
    )
    nearest = placed.where("NOT settled").groupBy("region").agg(F.min("d").alias("open_d"))
    if nearest.count() <= BROADCAST_ROWS:
        nearest = F.broadcast(nearest)
    kept = placed.join(nearest, "region").where(~F.col("settled") | (F.col("d") >= F.col("open_d") - RADIUS - 1e-9))
    cells = kept.groupBy("parent", "region").agg(F.sum("n").alias("total")).groupBy("parent").agg(F.sum("total").alias("all"), F.max("total").alias("most"))
    gauge = sizes.select(F.col("region").alias("parent"), F.col("total")).join(cells, "parent", "left")
    # A region of which nothing is left to be joined is divided.
    fits = F.coalesce((F.col("all") <= REPLICATION * F.col("total")) & (F.col("most") <= LARGEST_CELL * F.col("total")), F.lit(True))
    gauge = materialize(gauge.select("parent", fits.alias("fits")), "gauge")
    whole = gauge.where("NOT fits").select(F.col("parent").alias("region"))
    divided = gauge.where("fits").select("parent")
    divided = F.broadcast(divided) if gauge.count() <= BROADCAST_ROWS else divided
    return links, materialize(kept.join(divided, "parent", "left_semi").select("region", "a", "b", "n", "s"), "cells"), whole


def _blocks(members: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Regions that pivots don't divide, as pairs of blocks: every pair of documents meets in one, in bounded memory.

    The work grows with the square of a region's size over that of a task: of
    documents that are alike in a common part and linked with none, each two have
    to be compared by any exact join.
    """
    n = F.ceil(2 * F.col("total") / limit).cast("int")
    rows = members.join(sizes.select("region", "total"), "region").withColumn("blocks", n)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        F.concat_ws("/", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "a", "b", "n", "s"
    )


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("n").alias("total"))


def join_members(members: DataFrame, limit: int = REGION_SHINGLES) -> tuple[DataFrame, bool]:
    """All links needed to connect what is linked among ``members`` (region, a, b, n, s), and whether they are stars already."""
    found, divided = [], False
    for level in range(DIVISIONS + 1):
        sizes = materialize(_sizes(members), "sizes")
        large = sizes.where(F.col("total") > limit)
        some = large.count()
        if not some:
            found.append(_joined(members))
            break
        divided = True
        side = F.broadcast(large) if some <= BROADCAST_ROWS else large
        found.append(_joined(members.join(side.select("region"), "region", "left_anti")))
        big = members.join(side.select("region"), "region", "left_semi")
        if level == DIVISIONS:
            found.append(_joined(_blocks(big, large, limit)))
            break
        links, members, whole = _divide(big, large, level)
        found.append(links)
        n_whole = whole.count()
        if n_whole:
            side = F.broadcast(whole) if n_whole <= BROADCAST_ROWS else whole
            found.append(_joined(_blocks(big.join(side, "region", "left_semi"), large, limit)))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links, not divided


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of chosen documents to their sets; a text whose key is another (an id used twice) is passed over."""
    for batch in batches:
        rows = []
        for text, a, b in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("a", "b"))):
            s = shingles(text.as_py())
            if set_key(s) == (a, b):
                rows.append((a, b, len(s), s.tobytes()))
        columns = [*zip(*rows)] or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "n", "s"])
    _HASHES.clear()
    give_back()


def _ids_repeat(light: DataFrame) -> bool:
    return light.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _linked(docs: DataFrame, limit: int) -> DataFrame:
    """Per row of (``doc_id``, ``text``): doc_id, t (the text's hash), n (shingles), root (the same for all rows of a component)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.withColumn("t", F.xxhash64("text"))
    light = materialize(hashed.mapInArrow(_hash_documents, f"doc_id {kind}, t long, n long, few long, a long, b long"), "hashes")

    shares = docs.select("text").mapInArrow(_share_of, "s long, a long")
    shares = shares.repartition(shuffle_partitions(spark), "s").sortWithinPartitions("s", "a")
    common = shares.mapInArrow(_in_common, "a long, c long").groupBy("a").agg(F.sum("c").alias("c"))
    spare_ = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    sets = light.where("n > 1").groupBy("a", "b", "n", "few").agg(F.min(F.xxhash64("doc_id")).alias("h"))
    chosen = sets.join(common, "a", "left").where(F.coalesce("c", F.lit(0)) >= F.col("few") - spare_)
    chosen = materialize(chosen.select("a", "b", "h"), "chosen")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    members = docs.withColumn("h", F.xxhash64("doc_id")).join(side, "h").select("text", "a", "b")
    members = members.mapInArrow(_sets_of, "a long, b long, n long, s binary")
    members = materialize(members.dropDuplicates(["a", "b"]) if _ids_repeat(light) else members, "members")
    regions = materialize(_regions(members), "regions")
    side = F.broadcast(regions) if regions.count() <= BROADCAST_ROWS else regions
    members = members.join(side, ["a", "b"])
    links, are_stars = join_members(members, limit)
    u, v = F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")), F.struct(F.col("va").alias("a"), F.col("vb").alias("b"))
    if are_stars:
        roots = links.select(v.alias("node"), u.alias("root"))
    else:
        roots = components(links.select(u.alias("u"), v.alias("v")), "joined")
    roots = materialize(roots.distinct(), "roots")
    rows = light.withColumn("node", F.struct("a", "b")).join(roots, "node", "left")
    return rows.withColumn("root", F.coalesce("root", "node")).select("doc_id", "t", "n", "root")


def link_documents(docs: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """Per row of (``doc_id``, ``text``): doc_id, n_shingles, component_id.

    Two rows are linked when their sets' Jaccard index is 0.75 or more, equal
    sets included; ``component_id`` is the least ``doc_id`` reached.  Null, empty
    and blank texts have no shingles and are linked with nothing, so they keep
    their own id.  Repeated rows each get a row; null ids count as larger than
    any; other columns are ignored; an empty table gives an empty table.
    """
    rows = materialize(_linked(docs, limit), "components")
    least = _of_groups(rows, F.min("doc_id"))
    return rows.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _of_groups(rows: DataFrame, what: Column) -> DataFrame:
    """``least`` of each component of two rows or more, one small row a component.

    Broadcast up to ``BROADCAST_ROWS``; beyond it it is read from a written table,
    so that a join by component is one of two plain shuffles, and Spark can split a
    component with a large part of all rows.
    """
    groups = rows.where("n > 0").groupBy("root").agg(what.alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = materialize(groups.drop("rows"), "least")
    return F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups


#: What tells rows apart where one of each component is kept: id and hash of the text.
_KEY = ("__key_id", "__key_text")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least ``doc_id`` (nulls last), then of the least hash of text, with its own columns.

    Rows are told apart by id and text, so an id may stand in several components;
    of rows equal in both one stays.  Texts without shingles all stay.
    """
    found = materialize(_linked(docs, REGION_SHINGLES).where("n > 0"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    # Rows alone in their component stay without further ado, unless another row has the same id and text.
    found = found.join(_of_groups(found, F.min(rank)), "root", "left")
    least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t") == F.col("least.t"))
    found = found.withColumn("stays", F.col("least").isNull() | least)
    dropped = found.where("NOT stays").select(F.col("doc_id").alias(_KEY[0]), F.col("t").alias(_KEY[1])).distinct()
    again = found.where("stays").groupBy(F.col("doc_id").alias(_KEY[0]), F.col("t").alias(_KEY[1])).count().where("count > 1").drop("count")
    docs, own = put_aside(docs, _KEY)

    def same() -> Column:
        return F.col("doc_id").eqNullSafe(F.col(_KEY[0])) & (F.xxhash64("text") == F.col(_KEY[1]))

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    kept = docs.join(side(dropped), same(), "left_anti")
    if not again.limit(1).count():
        return kept.select(own)
    again = side(again)
    one = kept.join(again, same(), "left_semi").withColumn(_KEY[1], F.xxhash64("text")).dropDuplicates(["doc_id", _KEY[1]])
    return kept.join(again, same(), "left_anti").select(own).union(one.select(own))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return link_documents(read_table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) < {SHINGLE} THEN [w] ELSE
    list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: list_slice(w, i, i + {SHINGLE - 1})) END) AS x
  FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT p.rid AS u, q.rid AS v, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.rid <> q.rid GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n a ON a.rid = u JOIN n b ON b.rid = v WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(rid, reached) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.v FROM r JOIN e ON e.u = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(m.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r ON r.rid = d.rid JOIN d m ON m.rid = r.reached
GROUP BY d.rid, d.doc_id, n.n
"""
