"""A Merkle manifest of a dataset: leaves of rows, trees of groups, one root, and a proof for each row.

A row's leaf is the hash of its columns.  The leaves of a group ascend by key; while
a tree has more than one node, each run of three neighbours becomes their hash.
What remains is the group's root, and the roots of the groups, in order, are the
leaves of the tree that ends in the dataset's root.

Blocks of ``RUN ** LEVELS`` neighbours, which are whole subtrees, are reduced by tasks, each
to one node; rounds of it go on until at most ``TOP_NODES`` nodes are left, whatever
the size of a group or the number of groups.  The driver builds that small top tree
and broadcasts each node's path through it; executors finish the proofs and fold
each row's leaf by its own.  Digests are 32 bytes in tables and hex text where they
are hashed.

A path is a piece for each level: one byte, place in the run plus four times the
number of siblings, and the siblings' digests from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, materialize, put_aside, read_table, shuffle_partitions

#: Nodes to a run; levels that a task reduces at once, and so the leaves of a block.
RUN, LEVELS = 3, 7
#: Nodes of which the driver builds the rest, and broadcasts a path each: under 2 kB a node.
TOP_NODES = 16_384
#: Columns of the tables between.
ADDED = ("_tree", "_idx", "_n", "_digest", "_below", "_node", "_leaf", "_block", "_spot", "_part", "_other")


def field_text(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its bytes in UTF-8, counted, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """The leaf of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field_text(c) for c in columns)), 256))


def _hash(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def reduce_level(nodes: Sequence[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The next level of neighbouring nodes, and each node's piece of its path."""
    above, pieces = [], []
    for at in range(0, len(nodes), RUN):
        run = nodes[at : at + RUN]
        above.append(_hash(run))
        for place in range(len(run)):
            pieces.append(bytes([place + 4 * (len(run) - 1)]) + b"".join(run[:place]) + b"".join(run[place + 1 :]))
    return above, pieces


def reduce_tree(nodes: Sequence[bytes], levels: int | None = None) -> tuple[bytes, list[bytes]]:
    """The last node and each first node's path: of ``levels`` rounds, or of as many as leave one node."""
    paths, width, done = [b""] * len(nodes), 1, 0
    while done < levels if levels is not None else len(nodes) > 1:
        nodes, pieces = reduce_level(nodes)
        paths = [p + pieces[i // width] for i, p in enumerate(paths)]
        width, done = width * RUN, done + 1
    return nodes[0], paths


def siblings(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Of each level from below: the place in the run, and the other nodes of the run."""
    at = 0
    while at < len(path):
        place, n = path[at] & 3, path[at] >> 2
        yield place, [path[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(n)]
        at += 1 + 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, others in siblings(path):
        leaf = _hash([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(path: bytes) -> str:
    """The hash of all siblings on a path, hex."""
    return _hash([s for _, others in siblings(path) for s in others]).hex()


def ranked(rows: DataFrame, tree: str | None, by: Sequence[str], name: str) -> DataFrame:
    """Adds ``_idx``, a row's place among those of equal ``tree`` in order of ``by``, from 0, and ``_n``, how many those are.

    Rows are ranged by tree and order, so that a tree of a third of all rows lies over
    many tasks, and written with the place in their task; sums over counts by task
    and tree give the rest.  Nothing is sorted in one place but the counts.
    """
    keys = ([tree] if tree else []) + [c for c in by if c != tree]
    spot = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumns({"_spot": spot, "_part": F.shiftrightunsigned(spot, 33)}), name)
    rows = rows if tree else rows.withColumn("_none", F.lit(0))
    of = tree or "_none"
    counts = rows.groupBy(F.col(of).alias("_of"), F.col("_part").alias("_at")).agg(F.min("_spot").alias("_from"), F.count(F.lit(1)).alias("_here"))
    group = Window.partitionBy("_of")
    before = F.coalesce(F.sum("_here").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = materialize(counts.select("_of", "_at", "_from", before.alias("_before"), F.sum("_here").over(group).alias("_n")), f"{name}-firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, F.col(of).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    return rows.withColumn("_idx", F.col("_spot") - F.col("_from") + F.col("_before")).drop("_of", "_at", "_from", "_before", "_spot", "_part", "_none")


def _reduce_blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Rows (``_idx``, ``_n``, ``_digest`` and others) sorted by tree and place: adds ``_below`` and, to a block's first row, ``_node``."""
    block = RUN**levels

    def reduced(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        idx, n = rows.column("_idx").to_numpy(), rows.column("_n").to_numpy()
        digests = rows.column("_digest").to_pylist()
        starts = np.flatnonzero(idx % block == 0).tolist()
        below: list[bytes] = []
        nodes: list[bytes | None] = [None] * len(digests)
        for a, b in zip(starts, [*starts[1:], len(digests)]):
            # A tree of several blocks goes on, so each of its blocks rises by all levels, however few nodes it has.
            nodes[a], paths = reduce_tree(digests[a:b], levels if n[a] > block else None)
            below += paths
        rows = rows.append_column("_below", pa.array(below, pa.binary())).append_column("_node", pa.array(nodes, pa.binary()))
        yield from rows.to_batches()

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        # A block begins where the place is a multiple of its size, and blocks are not parted between tasks.
        last = int(np.flatnonzero(rows.column("_idx").to_numpy() % block == 0)[-1])
        if last:
            yield from reduced(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield from reduced(held)


def reduce_round(rows: DataFrame, name: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks to nodes: the rows with their paths below, and the nodes as rows of the same kind (``_tree``, ``_idx``, ``_n``, ``_digest``)."""
    block = RUN**levels
    rows = rows.withColumn("_block", F.expr(f"_idx div {block}"))
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "_tree", "_block").sortWithinPartitions("_tree", "_idx")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _below binary, _node binary"
    rows = materialize(rows.mapInArrow(lambda batches: _reduce_blocks(batches, levels), ddl), name)
    nodes = rows.where("_node IS NOT NULL").select("_tree", F.col("_block").alias("_idx"), F.expr(f"(_n + {block - 1}) div {block}").alias("_n"), F.col("_node").alias("_digest"))
    return rows.drop("_node"), nodes


def _top_tree(nodes: list, forest: bool) -> tuple[dict, bytes]:
    """Of the last nodes (tree, place, digest): each one's path to the root and its tree's root, and the root."""
    trees: dict = {}
    for tree, idx, digest in sorted(nodes, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        trees.setdefault(tree, []).append((idx, digest))
    reduced = {t: reduce_tree([d for _, d in of]) for t, of in trees.items()}
    if not forest:
        ((root, paths),) = reduced.values()
        return {(t, idx): (p, root) for t, of in trees.items() for (idx, _), p in zip(of, paths)}, root
    root, above = reduce_tree([r for r, _ in reduced.values()])
    found = {}
    for (t, of), suffix in zip(trees.items(), above):
        subroot, paths = reduced[t]
        found |= {(t, idx): (p + suffix, subroot) for (idx, _), p in zip(of, paths)}
    return found, root


def _with_suffix(rows: DataFrame, suffixes: dict) -> DataFrame:
    """Ends the paths of rows by the broadcast paths of their blocks; ``_subroot`` is filled where it is known from the top tree."""
    held = rows.sparkSession.sparkContext.broadcast(suffixes)
    has_subroot = "_subroot" in rows.columns
    kept = [f for f in rows.schema if f.name not in ("_below", "_subroot")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held.value
        for batch in batches:
            found = [top[t, b] for t, b in zip(batch.column("_tree").to_pylist(), batch.column("_block").to_pylist())]
            paths = [p + f[0] for p, f in zip(batch.column("_below").to_pylist(), found)]
            subroots = batch.column("_subroot") if has_subroot else pa.array([f[1] for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), subroots, pa.array(paths, pa.binary())], [*(f.name for f in kept), "_subroot", "_path"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _subroot binary, _path binary"
    return rows.mapInArrow(finish, ddl)


def _paths_up(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The paths of a round's rows through the round above, whose rows are the nodes of the blocks here."""
    above = above.select(F.col("_tree").alias("_t"), F.col("_idx").alias("_i"), F.col("_path").alias("_up"), F.col("_subroot").alias("_s"))
    rows = rows.join(above, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_block") == F.col("_i")))
    subroot = F.col("_subroot") if "_subroot" in rows.columns else F.col("_s")
    return rows.withColumns({"_path": F.concat("_below", "_up"), "_subroot": subroot}).drop("_t", "_i", "_up", "_s", "_below")


def with_paths(rows: DataFrame, forest: bool = True, top_nodes: int = TOP_NODES, levels: int = LEVELS) -> tuple[DataFrame, bytes | None]:
    """Rows (``_tree``, ``_idx``, ``_n``, ``_digest``) with ``_path`` and ``_subroot``, and the root; None of no rows.

    ``forest``: the trees' roots are the leaves of another tree.
    """
    rows, nodes = reduce_round(rows, "merkle", levels)
    left = nodes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if left[0] <= top_nodes:
        last = [(r[0], r[1], bytes(r[2])) for r in nodes.select("_tree", "_idx", "_digest").collect()]
        if not last:
            return rows.withColumns({"_path": F.lit(None).cast("binary"), "_subroot": F.lit(None).cast("binary")}).drop("_below"), None
        found, root = _top_tree(last, forest)
        return _with_suffix(rows, found), root
    if left[1] > 1:
        above, root = with_paths(nodes, forest, top_nodes, levels)
    else:
        # One node a tree, of too many trees: their roots in order are leaves of one tree, which has rounds of its own.
        roots = nodes.select(F.col("_tree").alias("_leaf"), F.col("_digest"), F.col("_digest").alias("_subroot"))
        roots = ranked(roots, None, ["_leaf"], "merkle-roots").withColumn("_tree", F.lit(None).cast("string"))
        above, root = with_paths(roots, False, top_nodes, levels)
        above = above.withColumn("_tree", F.col("_leaf")).withColumn("_idx", F.lit(0).cast("long"))
    return _paths_up(rows, above), root


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str], group: str, key: str, others: dict[str, Column] | None = None, top_nodes: int = TOP_NODES, levels: int = LEVELS
) -> tuple[DataFrame, str | None]:
    """Each row's ``key``, ``group``, leaf, group's root (``subroot``) and ``path`` (digests of 32 bytes), and the root in hex.

    ``others`` are further leaves by name, of the same columns after a change, which
    are carried along and may be folded by the row's own path.  Texts are hashed
    where they are read; digests alone are shuffled.  A null group is a group of
    its own and comes first, null keys come first; rows of one key are ordered by
    leaf, and repeated rows are leaves of their own.  An empty table has no root
    (None).  Columns of any name may be there; only those named are read.
    """
    others = others or {}
    rows = docs.select(
        F.col(key).alias("_key"), F.col(group).cast("string").alias("_tree"),
        leaf_digest(*(F.col(c) for c in columns)).alias("_digest"), *(c.alias(f"_of_{n}") for n, c in others.items()),
    )
    rows = ranked(materialize(rows, "leaves"), "_tree", ["_tree", "_key", "_digest"], "leaves-ranked")
    rows, root = with_paths(rows, True, top_nodes, levels)
    own = [F.col("_key").alias(key), F.col("_tree").alias(group), F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_path").alias("path")]
    return rows.select(*own, *(F.col(f"_of_{n}").alias(n) for n in others)), root.hex() if root else None


def check_leaves(manifest: DataFrame, leaf: str, root: str | None) -> DataFrame:
    """Adds ``proof_sha256``, ``folded_root`` (by the column ``leaf``, hex) and ``verified`` to rows of a manifest.

    The folds need the row alone: any subset of a manifest's rows can be checked, and
    against a root that is published elsewhere.
    """
    manifest, own = put_aside(manifest, ("proof_sha256", "folded_root"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema) + ", proof_sha256 string, folded_root string"

    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            proofs = [proof_digest(p) for p in paths]
            folded = [fold(d, p).hex() for d, p in zip(batch.column(leaf).to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], [*batch.schema.names, "proof_sha256", "folded_root"])

    return manifest.mapInArrow(fold_rows, ddl).select(*own, "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


#: What the query hashes, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' leaves and proofs by source; texts of even keys are folded as tampered with, without their line ends."""
    docs = read_table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    changed = F.when(cut.isNotNull(), leaf_digest(*(F.col(c) for c in COLUMNS[:-1]), cut)).otherwise(leaf_digest(*(F.col(c) for c in COLUMNS)))
    manifest, root = merkle_manifest(docs, COLUMNS, "source", "doc_id", {"seen": changed})
    rows = check_leaves(manifest, "seen", root)
    return rows.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")


def op11_sql(levels: int = 12) -> str:
    """The same level by level, for up to ``3 ** levels`` documents a source and as many sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in COLUMNS) + ")"

    # crc32 by its bits, over the decimal digits of a key.
    step = "list_reduce(list_concat([xor(c, d)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, d: {step}), 4294967295)"
    ctes = [
        f"""docs AS MATERIALIZED (SELECT doc_id, source, {leaf("text")} AS leaf,
            {leaf("(CASE WHEN " + crc + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS seen FROM documents)""",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs)",
        "a0 AS MATERIALIZED (SELECT source AS tree, idx, leaf AS d FROM leaves)",
    ]

    def tree(name: str, over: str) -> None:
        for i in range(levels):
            ctes.append(
                f"""{name}r{i} AS MATERIALIZED (SELECT tree, idx // {RUN} AS up, idx, d, count(*) OVER (PARTITION BY tree) AS n,
                coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // {RUN} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // {RUN} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{i})"""
            )
            ctes.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, up AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d FROM {name}r{i} GROUP BY tree, up)")
        ctes.append(
            f"{over} AS MATERIALIZED (SELECT z.tree, z.idx, "
            + " || ".join(f"CASE WHEN r{i}.n > 1 THEN r{i}.l || r{i}.r ELSE '' END" for i in range(levels))
            + " AS proof, ["
            + ", ".join(f"{{'n': r{i}.n, 'l': r{i}.l, 'r': r{i}.r}}" for i in range(levels))
            + f"] AS steps FROM {name}0 z "
            + " ".join(f"JOIN {name}r{i} r{i} ON r{i}.tree IS NOT DISTINCT FROM z.tree AND r{i}.idx = z.idx // {RUN**i}" for i in range(levels))
            + ")"
        )

    tree("a", "low")
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, d, tree AS source FROM a{levels})")
    tree("b", "high")

    def folded(start: str, steps: str) -> str:
        return f"list_reduce(list_concat([{{'n': 0::BIGINT, 'l': {start}, 'r': ''}}], {steps}), lambda x, y: {{'n': 0::BIGINT, 'l': CASE WHEN y.n > 1 THEN sha256(y.l || x.l || y.r) ELSE x.l END, 'r': ''}}).l"

    return f"""WITH {", ".join(ctes)},
    folds AS (SELECT v.doc_id, v.leaf, b0.d AS subroot, t.d AS root, sha256(low.proof || high.proof) AS proof_sha256, {folded("v.seen", "list_concat(low.steps, high.steps)")} AS folded_root
        FROM leaves v JOIN low ON low.tree IS NOT DISTINCT FROM v.source AND low.idx = v.idx
        JOIN b0 ON b0.source IS NOT DISTINCT FROM v.source JOIN high ON high.idx = b0.idx, b{levels} t)
    SELECT *, folded_root = root AS verified FROM folds"""
