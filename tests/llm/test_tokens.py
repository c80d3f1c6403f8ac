import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from poolwise.llm.bpe import ByteLevelEncoder, WordEncoder
from poolwise.llm.packing import Limits, Packer, pack
from poolwise.llm.planes import PlaneReader, PlaneWriter, shuffle, unshuffle
from poolwise.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from poolwise.llm.token_files import token_digests

PARTS = list("ab cd  \n\t\r\x0b\x0c\x00\x1c\x85\xa0éÉßÀÿ×÷İΣς’.,!123½٣日本ñ<|>_-") + ["'s", "'LL", " don't", "<|endoftext|>", "🙂", "\u2003", "\u3000", "e\u0301", "\n\n"]


def random_texts(n, seed):
    rng = random.Random(seed)
    plain = [p for p in PARTS if all(c.isascii() or c in "éÉßÀÿñ" for c in p)]
    return ["".join(rng.choice(rng.choice((PARTS, plain))) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("kind,name", [(ByteLevelEncoder, BYTE_VOCABULARY), (WordEncoder, WORD_VOCABULARY)])
def test_encoders_agree_with_the_library(kind, name, sample):
    ours = kind(public_tokenizers.path(name))
    texts = random_texts(3000, 1) + ["".join(p) for p in ([], ["a" * 5000], ["1 " * 3000])] + list(sample[1].values())
    for text, found in zip(texts, ours.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ours.encode(text.encode()), "<u4").tolist() == found.ids, repr(text)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_plane_files_round_trip(planes):
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 2 ** rng.integers(1, 32), size=rng.integers(0, 3000), dtype=np.uint32).astype("<u4").tobytes()) for i in range(40)]
    sink = io.BytesIO()
    writer = PlaneWriter(sink, planes, block_ids=1000)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    reader = PlaneReader(sink)
    assert [(d, b"".join(parts)) for d, _, parts in reader.documents()] == docs
    everything = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert (reader.block(3) == everything[3000:4000]).all()
    sink.seek(8)
    damaged = bytearray(sink.getvalue())
    damaged[-60] ^= 1
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(bytes(damaged)))


def test_planes_of_one_block():
    ids = np.array([0, 1, 5, 2**31], "<u4")
    for width in (1, 8):
        assert (unshuffle(shuffle(ids, width), 4, width) == ids).all()
    assert shuffle(np.zeros(9, "<u4"), 1) == []


def test_token_files_against_the_library(spark, sample, make_docs):
    docs, texts = sample
    rows = {r.doc_id: r for r in token_digests(spark, docs, public_tokenizers.path(BYTE_VOCABULARY), "bit").collect()}
    library = ByteLevelEncoder(public_tokenizers.path(BYTE_VOCABULARY)).library
    start = 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 0]
        assert rows[doc].start == start and rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd = make_docs([(7, None), (7, "a b"), (None, ""), (3, "x"), (-5, "y")])
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_digests(spark, odd, public_tokenizers.path(BYTE_VOCABULARY)).collect())
    assert [g[1] for g in got] == [None, -5, 3, 7, 7] and [g[0] for g in got] == [0, 1, 3, 5, 6]
    assert token_digests(spark, make_docs([]), public_tokenizers.path(BYTE_VOCABULARY)).count() == 0


def check_pieces(rows, texts, end=2):
    library = WordEncoder(public_tokenizers.path(WORD_VOCABULARY)).library
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # no padding


def test_packing_covers_each_id_once(spark, sample, make_docs):
    docs, texts = sample
    check_pieces(pack(docs, public_tokenizers.path(WORD_VOCABULARY)).collect(), texts)
    odd = {1: None, 2: "", 3: "word " * 9000, 4: "\x00", 5: "a"}
    check_pieces(pack(make_docs(odd.items()), public_tokenizers.path(WORD_VOCABULARY)).collect(), odd)
    assert pack(make_docs([]), public_tokenizers.path(WORD_VOCABULARY)).count() == 0
    assert pack(make_docs([(1, "a"), (1, "a")]), public_tokenizers.path(WORD_VOCABULARY)).count() == 2


def test_packer_keeps_every_limit():
    rng = random.Random(4)
    limits = Limits(tokens=64, segments=5, loss_tokens=40)
    packer = Packer(limits, task=3, window=20)
    total = 0
    for doc in range(400):
        n = rng.choice([1, 2, 3, 30, 64, 200])
        packer.add(doc, np.arange(n, dtype="<u4").tobytes(), rng.randint(0, n))
        total += n
    packer.finish()
    sequences = defaultdict(list)
    for row in packer.rows:
        sequences[row[5]].append(row)
    assert sum(r[2] for r in packer.rows) == total
    for rows in sequences.values():
        assert sum(r[2] for r in rows) <= 64 and len(rows) <= 5 and sum(r[7] for r in rows) <= 40
        assert rows[0][5] >> 32 == 3
