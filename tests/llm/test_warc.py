"""Archives: the standard library reads what we write, we read what it writes, damage raises."""

import gzip
import io
import zipfile
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from poolwise.llm import warc
from poolwise.llm.common import shared_path
from poolwise.llm.zip_reader import ZipRanges

SCHEMA = "page_id long, url string, html string"


def plain_records(rows):
    groups, out = {}, []
    for row in rows:
        groups.setdefault(row[2] or "", []).append(row[0])
    for html, ids in groups.items():
        body = html.encode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, page in enumerate(ids):
            revisit = k > 0 and len(body) >= 100
            out.append((page, len(body), sha256(body).hexdigest(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=repr)


def odd_rows():
    long, same = "é" * 60, "b" * 100
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else f"page {i} " * (i % 40)) for i in range(1, 120)]
    rows += [(200, None, None), (201, "http://a\r\nb c/é", ""), (202, "u", "a" * 99), (203, "u", "a" * 99)]
    rows += [(204, "u", long), (204, "u", long), (None, "u", long), (None, "u", "c" * 300), (None, "u", "c" * 300)]
    rows += [(205, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (206, "u", "xyz " * 2_000_000)]
    return rows


def pages_of(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("body", "digest", "row", "key", "n", "response", "hot", "path", "revisit", "first"):
        pages = pages.withColumn(name, F.lit("x"))
    return pages


def test_records_read_back_equal_the_pages(spark):
    rows = odd_rows()
    got = warc.archived(spark, pages_of(spark, rows)).drop("url").collect()
    assert sorted(map(tuple, got), key=repr) == plain_records(rows)
    assert warc.archived(spark, pages_of(spark, [])).count() == 0


def test_a_third_of_all_rows_in_one_payload_keeps_tasks_even(spark):
    rows = [(i, "u", "h" * 500 if i % 3 == 0 else f"{i // 2} " * 40) for i in range(3000)]
    typed = warc.typed(pages_of(spark, rows))
    packages = warc.write_packages(typed, shared_path(spark, "packages"), most=70)
    manifest = packages.collect()
    assert sum(p.n_records for p in manifest) == 3000
    assert max(p.n_records for p in manifest) <= 70
    got = warc.read_packages(packages).drop("url").collect()
    assert sorted(map(tuple, got), key=repr) == plain_records(rows)


def test_the_standard_library_reads_our_packages(spark):
    rows = odd_rows()[:30]
    packages = warc.write_packages(warc.typed(pages_of(spark, rows)), shared_path(spark, "packages"))
    seen = 0
    for p in packages.collect():
        with zipfile.ZipFile(p.path.removeprefix("file:")) as package:
            assert package.testzip() is None
            data = package.read(warc.ARCHIVE)
            for line in package.read(warc.INDEX).decode().splitlines():
                _, at, length = line.split(" ")
                text = gzip.decompress(data[int(at) : int(at) + int(length)])
                assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
                seen += 1
    assert seen == 30


def package_of(members, force=False, comment=b""):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
        for name, data in members.items():
            with package.open(name, "w", force_zip64=force) as member:
                member.write(data)
        package.comment = comment
    return sink.getvalue()


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("comment", [b"", b"x" * 65535, b"a PK\x05\x06 in it" + b"y" * 30])
def test_reader_on_packages_of_the_standard_library(force, comment):
    members = {"a/é.txt": b"line one\nline two\n\nlast", "empty": b"", "b": bytes(range(256)) * 500}
    package = ZipRanges(io.BytesIO(package_of(members, force, comment)))
    assert {n: package.read(n) for n in package.members} == members
    assert package.read("b", 300, 10) == members["b"][300:310]
    assert [list(package.lines("a/é.txt", part)) for part in (1, 7, 1 << 20)] == [[b"line one", b"line two", b"", b"last"]] * 3
    with pytest.raises(ValueError):
        package.read("b", 127_990, 11)


class SparseFile(io.RawIOBase):
    """Pieces of bytes at far places, zeros elsewhere."""

    def __init__(self, size, pieces):
        self.size, self.pieces, self.at, self.taken = size, pieces, 0, 0

    def seek(self, offset, whence=0):
        self.at = self.size + offset if whence == 2 else offset
        return self.at

    def read(self, n=-1):
        n = min(n, self.size - self.at)
        out = bytearray(n)
        for place, data in self.pieces.items():
            low, high = max(place, self.at), min(place + len(data), self.at + n)
            if low < high:
                out[low - self.at : high - self.at] = data[low - place : high - place]
        self.at += n
        self.taken += n
        return bytes(out)


def test_zip64_directory_of_members_beyond_four_gigabytes():
    import struct

    huge, first_at = 5 << 30, 0
    name, late = b"archive/data.warc.gz", b"indexes/records.idx"

    def local(n):
        return struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<2H2Q", 1, 16, 0, 0)

    late_at = first_at + len(local(name)) + huge
    index = b"- 0 10\n"
    directory_at = late_at + len(local(late)) + len(index)

    def entry(n, size, at):
        wide = struct.pack("<2H3Q", 1, 24, size, size, at)
        other = struct.pack("<2H4s", 0x7075, 4, b"ABCD")
        head = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(wide) + 8, 0, 0, 0, 0, 0xFFFFFFFF)
        return head + n + other + wide

    directory = entry(name, huge, first_at) + entry(late, len(index), late_at)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, len(directory), directory_at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, directory_at + len(directory), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = directory + end64 + locator + end
    payload = b"deep inside"
    pieces = {first_at: local(name), late_at: local(late) + index, directory_at: tail, first_at + len(local(name)) + (9 << 29): payload}
    source = SparseFile(directory_at + len(tail), pieces)
    package = ZipRanges(source)
    assert package.members["archive/data.warc.gz"].size == huge
    assert package.read("archive/data.warc.gz", 9 << 29, len(payload)) == payload
    assert list(package.lines("indexes/records.idx")) == [index.strip()]
    assert source.taken < 200_000


def test_damage_raises():
    good = package_of({"a": b"x" * 1000})
    for bad in (b"", b"PK", good[:-1], good[:500] + good[600:], good[: good.rfind(b"PK\x01\x02")] + b"PKxx" + good[good.rfind(b"PK\x01\x02") + 4 :]):
        with pytest.raises(ValueError):
            ZipRanges(io.BytesIO(bad)).read("a")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("a", "x" * 1000)
    with pytest.raises(ValueError):
        ZipRanges(packed).read("a")


def test_a_damaged_record_raises():
    data = warc.record("1", 5, "u", b"body " * 50, sha256(b"body " * 50).hexdigest(), False, None)
    assert warc.parse_record(memoryview(gzip.compress(data)))[:3] == (5, "u", 250)
    for bad in (data[:-1], data.replace(b"body body", b"bodY body"), data[4:], data[:40], data + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(memoryview(gzip.compress(bad)))
    with pytest.raises((ValueError, Exception)):
        warc.parse_record(memoryview(gzip.compress(data)[:-9]))
    with pytest.raises(ValueError):
        warc.parse_record(memoryview(gzip.compress(data) + b"tail"))
