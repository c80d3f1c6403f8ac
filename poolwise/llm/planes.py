"""A file format for token ids: fixed-size blocks, shuffled into bit or byte planes, zstandard per plane.

Layout: ``MAGIC``, the planes of block after block, the document index, the chunk index, the trailer.
Numbers are little-endian. A block holds ``block_ids`` ids (the last one fewer); only planes below the
highest set bit of the block are stored. The chunk index has a row for each block: place, number of
ids, number of planes, then the stored length of each plane. The document index has a bit for each document
without an id, then doc_id, delta coded, and length of every document, all compressed. The trailer has the places of both indexes, the number
of blocks, documents and ids, the block size, the plane width and a crc32 of all these.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"PLANES02"
HEAD = struct.Struct("<QQQQQII")
TAIL = struct.Struct("<I8s")
ENTRY = struct.Struct("<QII")
BLOCK_IDS = 65_536
WIDTHS = {"bit": 1, "byte": 8}


def shuffle(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of a block, lowest first."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if width == 8:
        planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [planes[:, k].tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits((ids >> k & 1).astype(np.uint8)).tobytes() for k in range(bits)]


def unshuffle(planes: list[bytes], n: int, width: int) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        part = raw if width == 8 else np.unpackbits(raw, count=n)
        ids |= part.astype("<u4") << np.uint32(k * width)
    return ids


class PlaneWriter:
    """Streams documents into a file; holds one block and the document index."""

    def __init__(self, sink, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.width, self.block_ids = sink, WIDTHS[planes], block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = self.n_ids = self.waiting = 0
        self.parts: list[bytes] = []
        self.chunks: list[bytes] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * self.block_ids:
            data = b"".join(self.parts)
            whole = len(data) - len(data) % (4 * self.block_ids)
            for start in range(0, whole, 4 * self.block_ids):
                self._block(data[start : start + 4 * self.block_ids])
            self.parts, self.waiting = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        planes = [self.zip.compress(p) for p in shuffle(ids, self.width)]
        self.chunks.append(ENTRY.pack(self.at, len(ids), len(planes)) + b"".join(struct.pack("<I", len(p)) for p in planes))
        self.n_ids += len(ids)
        for plane in planes:
            self._put(plane)

    def close(self) -> None:
        if self.waiting:
            self._block(b"".join(self.parts))
        nameless = np.packbits([doc is None for doc in self.docs]).tobytes()
        docs = np.array([0 if doc is None else doc for doc in self.docs], "<i8")
        deltas = np.diff(docs, prepend=docs[:1] * 0).tobytes()
        doc_index = self.zip.compress(nameless + deltas + np.array(self.lengths, "<u8").tobytes())
        chunk_index = b"".join(self.chunks)
        places = self.at, self.at + len(doc_index)
        self._put(doc_index)
        self._put(chunk_index)
        head = HEAD.pack(*places, len(self.chunks), len(docs), self.n_ids, self.block_ids, self.width)
        crc = zlib.crc32(doc_index + chunk_index + head)
        self._put(head + TAIL.pack(crc, MAGIC))


class PlaneReader:
    """Reads a file by its indexes; any block can be read alone."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - HEAD.size - TAIL.size)
        head = source.read(HEAD.size)
        doc_at, chunk_at, self.n_chunks, self.n_docs, self.n_ids, self.block_ids, self.width = HEAD.unpack(head)
        crc, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        end = size - HEAD.size - TAIL.size
        source.seek(min(doc_at, end))
        indexes = source.read(end - min(doc_at, end))
        if zlib.crc32(indexes + head) != crc:
            raise ValueError("the indexes are damaged")
        doc_index, chunk_index = indexes[: chunk_at - doc_at], indexes[chunk_at - doc_at :]
        bits = -(-self.n_docs // 8)
        raw = zstandard.ZstdDecompressor().decompress(doc_index, max_output_size=max(1, bits + 16 * self.n_docs))
        nameless = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=self.n_docs).tolist()
        docs = np.cumsum(np.frombuffer(raw, "<i8", self.n_docs, bits)).tolist()
        self.docs = [None if absent else doc for doc, absent in zip(docs, nameless, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", self.n_docs, bits + 8 * self.n_docs).astype(np.int64)
        self.chunks, at = [], 0
        for _ in range(self.n_chunks):
            place, n, planes = ENTRY.unpack_from(chunk_index, at)
            at += ENTRY.size
            self.chunks.append((place, n, struct.unpack_from(f"<{planes}I", chunk_index, at)))
            at += 4 * planes

    def block(self, k: int) -> np.ndarray:
        place, n, lengths = self.chunks[k]
        self.source.seek(place)
        unzip = zstandard.ZstdDecompressor()
        return unshuffle([unzip.decompress(self.source.read(x)) for x in lengths], n, self.width)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, length, its ids as bytes in parts) in the order of the file; take the parts before going on."""
        k, held = 0, b""

        def parts(left: int) -> Iterator[bytes]:
            nonlocal k, held
            while left:
                if not held:
                    held, k = self.block(k).tobytes(), k + 1
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part

        for doc, length in zip(self.docs, self.lengths.tolist(), strict=True):
            yield doc, length, parts(4 * length)
