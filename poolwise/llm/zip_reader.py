"""Reads stored members of a ZIP package by ranges: nothing is extracted, nothing but the asked bytes is read.

The end record, or with it the ZIP64 locator and end record, names the central directory; its entries,
with their ZIP64 fields, name the members; a member's own header says where its bytes begin. Damaged,
truncated or compressed packages raise ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the ZIP format.
END = struct.Struct("<4s4H2IH")
END_MARK = b"PK\x05\x06"
LOCATOR = struct.Struct("<4sIQI")
LOCATOR_MARK = b"PK\x06\x07"
END64 = struct.Struct("<4sQ2H2I4Q")
END64_MARK = b"PK\x06\x06"
ENTRY = struct.Struct("<4s6H3I5H2I")
ENTRY_MARK = b"PK\x01\x02"
LOCAL = struct.Struct("<4s5H3I2H")
LOCAL_MARK = b"PK\x03\x04"
COMMENT_MOST = 0xFFFF
ZIP64_FIELD = 1
STORED = 0
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipRanges:
    """``source`` is any seekable file of bytes."""

    def __init__(self, source):
        self.source = source
        self.size = source.seek(0, 2) or source.tell()
        self.members = {m.name: m for m in self._directory()}

    def _at(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError("the package is shorter than its directory says")
        self.source.seek(start)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the package is truncated")
        return data

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and place of the central directory."""
        tail_at = max(0, self.size - END.size - COMMENT_MOST)
        tail = self._at(tail_at, self.size - tail_at)
        found = tail.rfind(END_MARK)
        # A comment may hold the mark, too: the right record ends where the file does.
        while found >= 0 and (found + END.size > len(tail) or found + END.size + END.unpack_from(tail, found)[-1] != len(tail)):
            found = tail.rfind(END_MARK, 0, found)
        if found < 0:
            raise ValueError("no end record: not a ZIP package")
        _, disk, first_disk, _, entries, size, place, _ = END.unpack_from(tail, found)
        at = tail_at + found - LOCATOR.size
        if at >= 0:
            mark, _, end64, _ = LOCATOR.unpack(self._at(at, LOCATOR.size))
            if mark == LOCATOR_MARK:
                mark, _, _, _, disk, first_disk, _, entries, size, place = END64.unpack(self._at(end64, END64.size))
                if mark != END64_MARK:
                    raise ValueError("the ZIP64 locator does not name an end record")
        if disk != first_disk:
            raise ValueError("a package over several disks")
        return entries, size, place

    def _directory(self) -> Iterator[Member]:
        entries, size, place = self._end()
        directory, at = self._at(place, size), 0
        for _ in range(entries):
            if at + ENTRY.size > size:
                raise ValueError("the central directory is truncated")
            cells = ENTRY.unpack_from(directory, at)
            flags, method, packed, full, name_n, extra_n, comment_n, header = cells[3], cells[4], *cells[8:13], cells[16]
            if cells[0] != ENTRY_MARK:
                raise ValueError("the central directory is damaged")
            at += ENTRY.size
            name = directory[at : at + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            wide = self._wide(directory[at + name_n : at + name_n + extra_n])
            # The ZIP64 field holds only what its 32-bit place cannot, in this order.
            values = [next(wide) if value == FULL32 else value for value in (full, packed, header)]
            at += name_n + extra_n + comment_n
            yield Member(name, method, values[0], values[2])

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<2H", extra, at)
            if kind == ZIP64_FIELD:
                yield from struct.unpack_from(f"<{length // 8}Q", extra, at + 4)
                break
            at += 4 + length
        raise ValueError("a ZIP64 value is missing")

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method != STORED:
            raise ValueError(f"{name} is compressed and cannot be read by ranges")
        cells = LOCAL.unpack(self._at(member.header, LOCAL.size))
        if cells[0] != LOCAL_MARK:
            raise ValueError(f"{name} has no header of its own")
        at = member.header + LOCAL.size + cells[9] + cells[10]
        if at + member.size > self.size:
            raise ValueError(f"{name} reaches beyond the package")
        return at

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        size = self.members[name].size
        length = size - start if length is None else length
        if start < 0 or length < 0 or start + length > size:
            raise ValueError(f"{name} has no such range")
        return self._at(self.start(name) + start, length)

    def lines(self, name: str, part: int = 1 << 20) -> Iterator[bytes]:
        """The lines of a stored text member, read in parts."""
        size, held = self.members[name].size, b""
        for start in range(0, size, part):
            *whole, held = (held + self.read(name, start, min(part, size - start))).split(b"\n")
            yield from whole
        if held:
            yield held
