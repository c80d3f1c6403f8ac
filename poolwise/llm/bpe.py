"""Byte-pair encoding with a vocabulary file of the tokenizers library, a piece cache in front.

A byte-pair encoder works on the pieces that its pre-tokenizer cuts. Each distinct piece is encoded by
the library's model once and its ids are kept, as little-endian 32-bit bytes, in a bounded cache. Texts whose
letters are ASCII or Latin-1 are cut by the vocabulary's own pattern, written for UTF-8 bytes. All other
texts are cut only before runs of white space, which no piece crosses, and those parts go through the
library's normalizer and pre-tokenizer. Strings of special tokens are ordinary text.
``tests/llm/test_tokens.py`` holds both encoders against the library's own ``encode``.
"""

from __future__ import annotations

import re

import numpy as np

#: Pieces a worker keeps; the cache is emptied when it is full.
CACHE_PIECES = 600_000
LONGEST_CACHED = 64

#: Anything but ASCII and the letters of Latin-1, whose UTF-8 starts with C3.
BEYOND_LATIN = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]")
_WIDE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_PARTS = re.compile(f"[{_WIDE}]*[^{_WIDE}]+|[{_WIDE}]+")


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


SIGNS = byte_signs()


class PartCache(dict):
    """A part of a text to its ids, by the whole chain of the library."""

    def __init__(self, library):
        super().__init__()
        self.normalizer, self.splitter, self.model = library.normalizer, library.pre_tokenizer, library.model

    def __missing__(self, part: str) -> bytes:
        text = part if self.normalizer is None else self.normalizer.normalize_str(part)
        pieces = self.splitter.pre_tokenize_str(text)
        return self.keep(part, [t.id for piece, _ in pieces for t in self.model.tokenize(piece)])

    def keep(self, part, ids: list[int]) -> bytes:
        found = np.array(ids, "<u4").tobytes()
        if len(part) <= LONGEST_CACHED:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[part] = found
        return found


class PieceCache(PartCache):
    """A piece in UTF-8 to its ids, by the library's model."""

    def __missing__(self, piece: bytes) -> bytes:
        return self.keep(piece, [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(SIGNS))])


class Encoder:
    pieces: re.Pattern

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cached, self.wide = PieceCache(self.library), PartCache(self.library)

    def encode(self, data: bytes) -> bytes:
        """The ids of a UTF-8 text, four little-endian bytes each."""
        if data.isascii() or not BEYOND_LATIN.search(data):
            return b"".join(map(self.cached.__getitem__, self.pieces.findall(self.plain(data))))
        return b"".join(map(self.wide.__getitem__, WIDE_PARTS.findall(data.decode())))

    def plain(self, data: bytes) -> bytes:
        return data


class ByteLevelEncoder(Encoder):
    """For byte_bpe vocabularies: letters, digits or marks, each with a space before it, or white space."""

    pieces = re.compile(
        rb"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+"
    )


class WordEncoder(Encoder):
    """For word_bpe vocabularies: lower case, white space dropped, digits alone."""

    pieces = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\x80-\xff]+")

    def plain(self, data: bytes) -> bytes:
        return data.lower() if data.isascii() else data.decode().lower().encode()


_ENCODERS: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its cache lasts over tasks."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
