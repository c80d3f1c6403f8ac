"""Merkle manifest of the documents: a persistent path-copying tree over distributed, aligned blocks.

A leaf is the digest of a row's fields. The leaves of each language, in doc_id order, form a tree; the
roots of these, in language order, form the top tree, whose root names the whole table.

1. Leaves are hashed by Spark, staged as narrow rows and range-sorted by (language, doc_id). A row's
   position is its number within its task plus the rows of earlier tasks, a sum over one row per task
   and language, so a language that holds a third of all rows is only spread over more tasks.
2. Aligned blocks of ``2 ** levels`` neighbours become one row each. A task builds a block's tree and hands up
   its root; the roots of the blocks are the leaves of the next tier, until a language has one node.
   No block holds more leaves, and each tier has so many times fewer rows.
3. From the top down, every tier joins its blocks with the siblings above them and hands each child the
   siblings on its way to the root, again by (tree, position).
4. In the lowest tier each tampered leaf is a version of its block: ``PersistentTree`` copies the leaf's
   ancestors and shares all other nodes. The version goes on over the siblings above the block, copying
   one node a level. Versions are dealt with their blocks, so no task holds those of an upper node.

Defined results: a null field is hashed as ``-``; a null language is a language of its own, before all
others; a null doc_id sorts first in its language and is never tampered with; equal doc_ids follow in
the order of their leaves; a text is hashed as a whole, whatever its length; a tampered n_chars may
exceed a long, as it is hashed as decimal digits; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, staged

#: A block has 2 ** LEVELS leaves.
LEVELS = 10
TAMPER = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = bytes(1)

NODES = "tree binary, pos long, digest string, n long"
PATHS = "tree binary, block long, steps array<string>, subroot string, root string"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copies array<string>"
)


def field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and, for rows that are tampered with, the leaf afterwards."""
    rows = docs.select(*[F.col(f"`{c}`") for c in FIELDS])

    def hashed(n_chars: Column) -> Column:
        return F.sha2(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]).cast("binary"), 256)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    marked = F.when(F.col("lang").isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.col("lang").cast("binary")))
    return rows.select(
        marked.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        hashed(F.col("n_chars")).alias("digest"),
        F.when(tampered, hashed(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("altered"),
    )


def numbered(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the rank within the tree by ``order``, and ``n``, the size of the tree."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            seq = []
            for tree in batch.column("tree").to_pylist():
                if tree != last:
                    last, seen = tree, 0
                seq.append(seen)
                seen += 1
            extra = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(seq, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "seq"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    # Rows that agree in everything are interchangeable; the number spreads them over tasks.
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree"), *order, F.col("tie")]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    parts = staged(ordered.mapInArrow(number, f"{fields}, part int, seq long"), name)
    tree = Window.partitionBy("tree")
    sizes = parts.groupBy("tree", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(tree).alias("n"))
    return parts.join(starts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("seq")).drop("part", "seq", "before")


def blocks_of(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """A row for each aligned block: tree, block, n, and its nodes in order."""
    payload = [c for c in nodes.columns if c not in ("tree", "n")]
    held = F.array_sort(F.collect_list(F.struct("pos", *[c for c in payload if c != "pos"])))
    keyed = nodes.withColumn("block", F.shiftright("pos", levels))
    grouped = keyed.groupBy("tree", "block").agg(F.max("n").alias("n"), held.alias("held"))
    flat = [F.col(f"held.{c}").alias(c) for c in payload if c != "pos"]
    return staged(grouped.select("tree", "block", "n", *flat), name)


def height_of(n: int, levels: int) -> int:
    """Levels of a block in a tier of ``n`` nodes."""
    return min(levels, (n - 1).bit_length())


def block_roots(blocks: DataFrame, levels: int, name: str) -> DataFrame:
    """The nodes of the next tier."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .merkle_tree import PersistentTree

        names, types = ["tree", "pos", "digest", "n"], [pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            sizes, digests = batch.column("n").to_pylist(), []
            for n, held in zip(sizes, batch.column("digest").to_pylist(), strict=True):
                tree = PersistentTree(held, height_of(n, levels))
                digests.append(tree.digest[tree.root])
            above = [-(-n >> levels) for n in sizes]
            yield arrow_batch(names, types, [batch.column("tree"), batch.column("block"), digests, above])

    return staged(blocks.select("tree", "block", "n", "digest").mapInArrow(build, NODES), name)


def tiers_of(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of each tier and the trees that end in it, as (tree, digest)."""
    tiers, ended = [], []
    while True:
        tiers.append(blocks_of(nodes, levels, f"{name}-blocks"))
        above = block_roots(tiers[-1], levels, f"{name}-roots")
        ended.append(above.where("n = 1").select("tree", "digest"))
        nodes = above.where("n > 1")
        if nodes.isEmpty():
            return tiers, ended


def paths_below(blocks: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """For each node of a tier, the siblings on its way up."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .merkle_tree import PersistentTree

        names = ["tree", "block", "steps", "subroot", "root"]
        types = [pa.binary(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                tree, first = PersistentTree(row["digest"], height_of(row["n"], levels)), row["block"] << levels
                cells = [
                    (row["tree"], first + i, tree.steps(tree.root, i) + row["steps"], row["subroot"], row["root"])
                    for i in range(len(row["digest"]))
                ]
                yield arrow_batch(names, types, list(zip(*cells, strict=True)))

    joined = blocks.select("tree", "block", "n", "digest").join(paths, ["tree", "block"])
    return joined.select("tree", "block", "n", "digest", "steps", "subroot", "root").mapInArrow(spread, PATHS)


def down(tiers: list[DataFrame], ended: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The paths of the blocks of the lowest tier; ``tops`` has those of whole trees: tree, steps, subroot, root."""
    paths = None
    for k in reversed(range(len(tiers))):
        here = ended[k].join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
        paths = here if paths is None else here.unionByName(paths_below(tiers[k + 1], paths, levels))
    return paths


def prove(blocks: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Per leaf: its proof, and the root that it, or its tampered version, leads to."""

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .merkle_tree import PersistentTree, climb, digest_of

        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copies"]
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        for batch in batches:
            for row in batch.to_pylist():
                tree, above, cells = PersistentTree(row["digest"], height_of(row["n"], levels)), row["steps"], []
                for i, (doc, leaf, altered) in enumerate(zip(row["doc_id"], row["digest"], row["altered"], strict=True)):
                    steps = tree.steps(tree.root, i)
                    copies = []
                    if altered is None:
                        folded = [leaf, *climb(leaf, steps + above)][-1]
                    else:
                        mark = len(tree.digest)
                        version = tree.replaced(tree.root, i, altered)
                        copies = tree.digest[mark:] + climb(tree.digest[version], above)
                        folded = copies[-1]
                    proof = digest_of(*[s[1:] for s in steps + above])
                    cells.append((doc, leaf, row["subroot"], row["root"], proof, folded, folded == row["root"], copies))
                yield arrow_batch(names, types, list(zip(*cells, strict=True)))

    joined = blocks.join(paths, ["tree", "block"])
    return joined.select("n", "doc_id", "digest", "altered", "steps", "subroot", "root").mapInArrow(versions, PROOFS)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, of a tampered leaf, the copied nodes."""
    rows = staged(leaves(docs), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    tiers, ended = tiers_of(numbered(rows, "ranked", order), levels, "merkle")
    subroots = ended[0]
    for more in ended[1:]:
        subroots = subroots.unionByName(more)
    # The top tree: its leaves are the subroots, in the order of their languages.
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang"), "digest")
    placed = staged(numbered(named, "subroots", [F.col("lang")]), "top")
    top_tiers, top_ended = tiers_of(placed.select("tree", "pos", "digest", "n"), levels, "top")
    nothing_above = F.array().cast("array<string>").alias("steps")
    root = top_ended[-1].select("tree", nothing_above, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    top_paths = down(top_tiers, top_ended, root, levels)
    of_lang = paths_below(top_tiers[0], top_paths, levels).select(F.col("block").alias("pos"), "steps", "root")
    tops = placed.select(F.col("lang").alias("tree"), "pos", F.col("digest").alias("subroot")).join(of_lang, "pos")
    paths = down(tiers, ended, tops.select("tree", "steps", "subroot", "root"), levels)
    return prove(tiers[0], staged(paths, "paths"), levels)
