"""Long texts, hot rows and odd keys of the operators over documents."""

import io
import random
import time

import numpy as np
import public_tokenizers
from brute import contamination as plain_contamination
from pyspark.sql import functions as F

from poolwise.llm import language_id, pii
from poolwise.llm.decontaminate import NgramSet, contamination, words_of
from poolwise.llm.packing import Limits, Packer
from poolwise.llm.planes import PlaneReader, PlaneWriter
from poolwise.llm.queries import BYTE_VOCABULARY
from poolwise.llm.token_files import token_digests

WORDS = "one two three four five six seven eight nine ten".split()


def test_items_without_an_id_hit_words_but_are_not_listed(spark, make_docs):
    text = "x " + " ".join(WORDS) + " y"
    docs = make_docs([(1, text), (2, "nothing"), (None, text), (4, " ".join(WORDS[:3]))])
    for items in ([(None, " ".join(WORDS))], [(None, " ".join(WORDS)), (7, "seven eight nine")], [(None, "two three"), (None, " ".join(WORDS))]):
        got = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        want = set()
        for doc, t in ((1, text), (2, "nothing"), (None, text), (4, " ".join(WORDS[:3]))):
            hit, found = plain_contamination(t, dict(enumerate(x for _, x in items)))
            named = {items[k][0] for k in found} - {None}
            want.add((doc, len(hit), len(named), bool(hit)))
        assert got == want


def test_window_arrays_equal_plain_windows_and_stay_small():
    rng = random.Random(1)
    items = [(None if k % 5 == 0 else k // 2, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))).encode()) for k in range(60)]
    grams = NgramSet(items, 3)
    for _ in range(60):
        words = [rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randint(0, 40))]
        hit, found = plain_contamination(" ".join(words), {k: t.decode() for k, (_, t) in enumerate(items)}, 3)
        places, ids = grams.find([w.encode() for w in words])
        assert set(places.tolist()) == hit
        assert ids == sorted({items[k][0] for k in found} - {None})
    many = NgramSet([(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(1000)).encode()) for k in range(200)], 10)
    n = sum(len(s[0]) for s in many.sets.values())
    assert n > 190_000
    assert many.flat.nbytes + sum(a.nbytes for s in many.sets.values() for a in s) < 40 * n


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(NgramSet, "rolling", staticmethod(lambda columns: (columns[0].astype(np.uint64) * 0 + 3)))
    grams = NgramSet([(1, b"a b"), (2, b"b a"), (3, b"c c")], 2)
    assert grams.find([b"b", b"a", b"b", b"x", b"c"])[1] == [1, 2]
    assert grams.find([b"c", b"c"])[1] == [3]


def test_a_long_text_is_decontaminated_as_a_whole():
    filler = b"lorem ipsum dolor " * 1_100_000
    text = filler + " ".join(WORDS).encode() + b" " + filler[:1000]
    places, found = NgramSet([(5, " ".join(WORDS).encode())], 10).find(words_of(text))
    assert places.tolist() == list(range(3_300_000, 3_300_010)) and found == [5]


def test_twenty_million_ids_are_packed_in_seconds():
    ids = np.arange(20_000_000, dtype="<u4").tobytes()
    packer = Packer(Limits(), 0)
    began = time.time()
    packer.add(1, ids)
    packer.finish()
    assert time.time() - began < 10
    assert sum(r[2] for r in packer.rows) == 20_000_000
    assert all(x[2] & (x[2] - 1) == 0 for x in packer.rows if x[0] == 1)


def test_loss_tokens_bind():
    packer = Packer(Limits(4096, 256, 1024), 0)
    rng = random.Random(2)
    for k in range(300):
        n = rng.randint(1, 3000)
        packer.add(k, bytes(4 * n), rng.randint(0, n))
    packer.add(300, bytes(4 * 20_000), 15_000)
    packer.finish()
    by_sequence, by_doc = {}, {}
    for doc, start, length, _, total, sequence, _, loss in packer.rows:
        by_sequence.setdefault(sequence, []).append((length, loss))
        by_doc.setdefault(doc, []).append((start, length, total))
    assert all(sum(x for x, _ in p) <= 4096 and sum(x for _, x in p) <= 1024 and len(p) <= 256 for p in by_sequence.values())
    assert sum(sum(x for _, x in p) == 1024 for p in by_sequence.values()) > 20
    for pieces in by_doc.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]


def test_plane_files_keep_missing_and_smallest_ids():
    docs = [None, None, -(1 << 63), -(1 << 63), 0, (1 << 63) - 1]
    sink = io.BytesIO()
    writer = PlaneWriter(sink)
    for k, doc in enumerate(docs):
        writer.add(doc, np.arange(k, dtype="<u4").tobytes())
    writer.close()
    assert [(d, n) for d, n, p in PlaneReader(sink).documents() if [*p] is not None] == list(zip(docs, range(6), strict=True))


def test_one_doc_id_of_a_third_of_all_rows_is_spread(spark, make_docs):
    rows = [(None if i % 6 == 0 else 5 if i % 3 == 0 else i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = make_docs(rows, extra=False).repartition(8)
    got = token_digests(spark, docs, public_tokenizers.path(BYTE_VOCABULARY)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))


def test_texts_scored_in_parts_equal_whole_texts(monkeypatch):
    rng = random.Random(7)
    counts = {}
    for lang, alphabet in (("a", "abc "), ("b", "bcdé ")):
        grams = counts.setdefault(lang, {})
        codes = [ord(c) if c != " " else 0 for c in (rng.choice(alphabet) for _ in range(3000))]
        for k in range(3, len(codes)):
            gram = tuple(codes[k - 3 : k + 1])
            grams[gram] = grams.get(gram, 0) + 1
    model = language_id.LanguageModels.fit(counts)
    texts = ["", "12 ", " a1b", "".join(rng.choice("aAbc d1é") for _ in range(997)), "ab" * 50, "1" * 200 + "a"]
    whole = model.entropies(texts)
    for part in (1, 7, 100):
        monkeypatch.setattr(language_id, "PART", part)
        parts = model.entropies(texts)
        assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(whole, parts, strict=True))


def altered_documents(docs, seed):
    """Held-out documents with one base span rewritten, and where the new form stands."""
    rng = random.Random(seed)
    for doc, text in docs:
        for start, end, kind in pii.base_spans(text)[:2]:
            low, high = max(0, start - 200), min(len(text), end + 200)
            others = [s for s in pii.base_spans(text[low:high]) if s[:2] != (start - low, end - low)]
            made = pii.altered(text[low:high], [(start - low, end - low, kind)], rng)
            if made and not others and kind:
                yield doc, made[0], made[1]


def test_the_segment_model_finds_altered_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike("@|[0-9]{3}"))
    learn = docs.where(F.col("doc_id") % 3 != 0)
    weights = pii.fit(learn)
    held_out = [(r.doc_id, r.text) for r in docs.where("doc_id % 3 = 0").collect()]
    right = wrong = wanted = 0
    for _, text, labels in altered_documents(held_out, 11):
        base = pii.base_spans(text)
        labels = [x for x in labels if not any(s < x[1] and x[0] < e for s, e, _ in base)]
        added = pii.added_spans(text, base, weights)
        wanted += len(labels)
        right += sum(x in labels for x in added)
        wrong += sum(x not in labels for x in added)
    assert wanted > 60
    assert right >= 0.9 * wanted
    assert right >= 0.9 * (right + wrong)


def segmentations(segments, n, at=0):
    """Every set of segments that do not overlap, as lists of their numbers."""
    if at >= n:
        yield []
        return
    yield from segmentations(segments, n, at + 1)
    for k, (i, j, *_) in enumerate(segments):
        if i == at:
            for rest in segmentations(segments, n, j):
                yield [k, *rest]


def test_lattices_equal_an_enumeration_of_all_segmentations():
    rng = random.Random(5)
    windows = ["+1 (212) 555-0199 x", "4111.1111.1111.1111", "call 212-555-0199-12", "a at b dot com", "1[.]2[.]3[.]4 or 10.0.0.7"]
    checked = 0
    for window in windows:
        lattice = pii.Lattice(window)
        names = {f for *_, found in lattice.segments for f in found}
        weights = {f: rng.uniform(-1, 1) for f in names}
        scores, sure, log_total = lattice.marginals(weights)
        every = list(segmentations(lattice.segments, len(lattice.tokens)))
        values = np.array([sum(scores[k] for k in chosen) for chosen in every])
        mass = np.exp(values)
        assert np.isclose(np.log(mass.sum()), log_total)
        for k in range(len(lattice.segments)):
            share = sum(m for m, chosen in zip(mass, every, strict=True) if k in chosen) / mass.sum()
            assert np.isclose(share, sure[k])
            checked += 1
        best = {(lattice.tokens[lattice.segments[k][0]][0], lattice.tokens[lattice.segments[k][1] - 1][1]) for k in every[int(values.argmax())]}
        assert {(s, e) for s, e, *_ in lattice.best(weights)} == best
    assert checked > 10
