"""The Merkle manifest against a plain tree over lists."""

import zlib
from hashlib import sha256

import pytest

from poolwise.llm.merkle import manifest
from poolwise.llm.merkle_tree import PersistentTree, climb


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, source, lang, n_chars, text):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)]
    return hashed(*shown)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way_up(levels, at):
    for level in levels[:-1]:
        yield at & 1, level[at ^ 1] if at ^ 1 < len(level) else None
        at >>= 1


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    placed = {lang: sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for lang in order}
    built = {lang: levels_of([leaf_of(*r) for r in placed[lang]]) for lang in order}
    top = levels_of([built[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, row in enumerate(placed[lang]):
            steps = [*way_up(built[lang], i), *way_up(top, k)]
            doc, source, _, n_chars, text = row
            cur = leaf = leaf_of(*row)
            if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n_chars is not None:
                cur = leaf_of(doc, source, lang, n_chars + 1, text)
            for right, sibling in steps:
                cur = hashed(cur) if sibling is None else hashed(sibling, cur) if right else hashed(cur, sibling)
            proof = hashed(*[s for _, s in steps if s is not None])
            out.append((doc, leaf, built[lang][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_with_all_cases():
    rows = [(i, "s" if i % 3 else None, ["en", "de", None, "é", "z"][min(i % 9, 4)], None if i % 11 == 0 else i, f"text {i} ü") for i in range(150)]
    rows += [(7, "s", "en", 1, "again"), (7, "s", "en", 1, "again"), (None, None, None, None, None), (None, "s", "en", 5, None)]
    rows += [(1000 + i, "s", "en", (1 << 63) - 1, "") for i in range(8)] + [(2000, "s", "lone", 3, "x" * 3_000_000)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, levels):
    from pyspark.sql import functions as F

    rows = rows_with_all_cases()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("tree", "digest", "altered", "pos", "n", "part", "block", "root", "leaf"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted((tuple(r)[:7] for r in manifest(docs, levels).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_tampering_copies_one_node_a_level(spark):
    rows = [(i, "s", "en", i, "t") for i in range(37)]
    for r in manifest(spark.createDataFrame(rows, SCHEMA), 2).collect():
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified != tampered
        assert len(r.copies) == (7 if tampered else 0)
        if tampered:
            assert r.copies[-1] == r.folded_root


def test_one_text_in_all_rows_and_an_empty_table(spark):
    rows = [(3, "s", "en", 1, "same")] * 90 + [(i, "s", "en", 1, "same") for i in range(30)]
    got = sorted((tuple(r)[:7] for r in manifest(spark.createDataFrame(rows, SCHEMA), 3).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_versions_share_nodes(n):
    leaves = [hashed(str(i)) for i in range(n)]
    tree = PersistentTree(leaves, (n - 1).bit_length())
    before, first = len(tree.digest), tree.digest[tree.root]
    for i in range(n):
        root = tree.replaced(tree.root, i, hashed("new"))
        assert len(tree.digest) - before == tree.height + 1
        before = len(tree.digest)
        changed = [*leaves[:i], hashed("new"), *leaves[i + 1 :]]
        assert tree.digest[root] == levels_of(changed)[-1][0]
        assert tree.digest[tree.root] == first == [leaves[i], *climb(leaves[i], tree.steps(tree.root, i))][-1]
