import hashlib
import random

import numpy as np

from brute import near_components, normal, shingles
from poolwise.llm import near_dedup
from poolwise.llm.common import kept_rows
from poolwise.llm.components import components
from poolwise.llm.exact_dedup import exact_groups
from poolwise.llm.fast_sketch import EMPTY, band_keys, sketches
from poolwise.llm.near_dedup import near_groups
from poolwise.llm.shingles import shingle_sets
from poolwise.llm.trie import PatriciaTrie


def test_trie_splits_edges_and_frees_finished_subtrees():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)})
    trie, done = PatriciaTrie(), []
    for key in keys:
        node = trie.terminal(key)
        assert node.entry is None
        node.entry = [key]
        done.extend(trie.finished(key))
        assert trie.terminal(key) is node
    held = trie.held
    done.extend(trie.drain())
    assert sorted(x[0] for x in done) == keys and held <= 12
    shuffled = keys[:]
    rng.shuffle(shuffled)
    for key in shuffled + keys:
        node = trie.terminal(key)
        node.entry = [key, (node.entry or [0, 0])[1] + 1]
    assert sorted(trie.drain()) == [[k, 2] for k in keys]


def test_exact_groups_on_odd_rows(make_docs):
    pairs = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (4, ""), (None, "a b"), (2, "a b"), (7, "é" * 50_000), (8, "é" * 50_000)]
    rows = exact_groups(make_docs(pairs)).collect()
    assert len(rows) == len(pairs)
    groups = {}
    for doc, text in pairs:
        groups.setdefault(normal(text), []).append(doc)
    for r in rows:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(members) and r.keep_id == min(x for x in members if x is not None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_groups(make_docs([])).count() == 0


def test_kept_rows_leaves_one_of_rows_that_repeat(make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, None)])
    left = kept_rows(docs, exact_groups(docs))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "c"), (1, "a"), (1, "b"), (3, "")]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for size in (1, 3, 40, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, size * 6 // 7)], rng.integers(0, 2**63, size // 7, dtype=np.uint64)]))
        table = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 192)
        assert (table != EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((table[0] == table[1]).mean() - true) < 0.15
        keys = band_keys(table, 4)
        assert (keys[0] == keys[1]).any()


def test_shingle_sets_count_distinct_shingles():
    texts = ["", "one", "A b  c D", "a b c d", "a b c d e", "x " * 200, "a b c d e f a b c d e f"]
    values, bounds = shingle_sets([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert values[bounds[2]] == values[bounds[3]]


def mutated(rng, words, share):
    return " ".join(rng.choice("qwertyuiop") * 3 if rng.random() < share else w for w in words)


def near_fixture():
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {i: mutated(rng, base, rng.choice([0.0, 0.01, 0.02, 0.05, 0.2])) for i in range(90)}
    texts |= {100 + i: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))) for i in range(40)}
    texts |= {200: "", 201: None, 202: "one two", 203: "ONE  two", 204: texts[3], 205: "a b c d e f g h i", 206: "a b c d e f g h i j", 207: "z " * 3000}
    return texts


def test_near_groups_equal_brute_force(make_docs, monkeypatch):
    texts = near_fixture()
    wanted = near_components(texts)
    for cell in (2048, 7):
        monkeypatch.setattr(near_dedup, "CELL", cell)
        rows = near_groups(make_docs(texts.items())).collect()
        assert {r.doc_id: r.component_id for r in rows} == wanted
        assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingles(t)) for i, t in texts.items()}
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_groups_on_repeated_rows_and_null_ids(make_docs):
    text = " ".join(map(str, range(30)))
    docs = make_docs([(4, text), (4, text), (None, text + " x"), (None, "alone"), (6, None)])
    rows = near_groups(docs).collect()
    assert sorted((r.component_id or 0, r.kept) for r in rows) == [(0, True), (4, False), (4, False), (4, True), (6, True)]
    assert near_groups(make_docs([])).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(parent)}
    assert len(got) == len(parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
