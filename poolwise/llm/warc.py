"""WARC records in ZIP packages, read back by ranges.

A package is a ZIP file whose members are stored: ``archive/data.warc.gz`` holds one gzip member for
each record, ``indexes/records.idx`` a line for each record with its place in the archive member.

1. Spark hashes the payloads. Counts and smallest page_ids of equal payloads are aggregated on narrow
   rows; only payloads that occur more than once are kept. A payload that holds over one row in
   ``HOT_SHARE`` is hot; there are fewer than ``HOT_SHARE`` of these, so they are broadcast. The others
   are joined by digest, where no key has more than that share; hot rows take keys of their own there.
2. Each task streams its records into packages of at most ``PACKAGE_RECORDS`` records. A file's name
   holds the task attempt; only packages of the attempt that succeeded are in the manifest.
3. The reader parses the (ZIP64) directories, locates both members, reads the index by ranges and hands
   out spans of neighbouring records, ``SPAN_BYTES`` at most or a single record. Spans are dealt to
   tasks anew, and a task reads each span, and inflates each record in parts, straight from the package.

Of equal payloads of at least ``REVISIT_BYTES`` bytes, the row with the smallest page_id is a response;
the others are revisits and carry its headers only. Shorter payloads are always responses.

Defined results: a null html is an empty payload; a null page_id sorts after all others; of rows that
repeat both the payload and the smallest page_id just one is the response; control characters in a url are
percent-encoded in its header, a null url gives none; an html is written and read as a whole, whatever
its length; further columns are ignored; an empty table gives no packages and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, shared_path, slices, staged, text_bytes
from .token_files import open_shared

REVISIT_BYTES = 100
HOT_SHARE = 1000
PACKAGE_RECORDS = 50_000
SPAN_BYTES = 4 << 20
SPAN_RECORDS = 1024
INFLATE_BYTES = 1 << 20
READ_BYTES = 64 << 20

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/records.idx"
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"
ID_MARK = "urn:page:"

PACKAGES = "path string, n_records long, n_bytes long"
SPANS = "path string, at long, lengths array<long>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, body, digest, revisit and, of revisits, the response's page_id as ``first``."""
    body = text_bytes("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    again = staged(
        rows.where(F.octet_length("body") >= REVISIT_BYTES)
        .groupBy("digest", "page_id")
        .agg(F.count("*").alias("ties"))
        .groupBy("digest")
        .agg(F.sum("ties").alias("n"), F.min(F.struct(F.isnull("page_id").alias("nameless"), "page_id", "ties")).alias("least"))
        .where("n > 1")
        .select("digest", "n", F.struct("least.page_id", "least.ties").alias("response")),
        "payloads",
    )
    copies = again.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    # Each has more than a thousandth of all copies, so there are fewer than a thousand.
    hot = again.where(F.col("n") > copies // HOT_SHARE).select("digest", F.col("response").alias("hot"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    own_key = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    keyed = marked.withColumn("key", F.when(F.col("hot").isNotNull(), own_key).otherwise(F.col("digest")))
    found = keyed.join(again.select(F.col("digest").alias("key"), "response"), "key", "left")
    response = F.coalesce("hot", "response")
    placed = found.select("page_id", "url", "body", "digest", response["page_id"].alias("first"), response["ties"].alias("ties"))
    later = F.col("ties").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "body", "digest", "revisit", F.when(F.col("revisit"), F.col("first")).alias("first")]
    if again.where("response.ties > 1").isEmpty():
        return placed.withColumn("revisit", later).select(*columns)
    # Rows that repeat the smallest page_id are told apart by their place in a staged table.
    tied = (F.col("ties") > 1) & ~later
    repeats = staged(placed.where(tied).drop("ties"), "ties").withColumn("row", F.monotonically_increasing_id())
    chosen = repeats.groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(False).alias("revisit"))
    settled = repeats.join(chosen, "row", "left").withColumn("revisit", F.coalesce("revisit", F.lit(True)))
    others = placed.where(~F.coalesce(tied, F.lit(False))).withColumn("revisit", later)
    return others.select(*columns).unionByName(settled.select(*columns))


def header_lines(pairs: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{name}: {value}\r\n".encode() for name, value in pairs)


def record(number: str, page_id: int | None, url: str | None, body: bytes, digest: str, revisit: bool, first: int | None) -> bytes:
    """A record, not yet compressed. The HTTP header keeps the length of the full payload in a revisit, too."""
    http = b"HTTP/1.1 200 OK\r\n" + header_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]) + b"\r\n"
    shown = "" if page_id is None else str(page_id)
    block = http if revisit else http + body
    # Only a response that others may refer to is named by its payload.
    named = number if revisit or len(body) < REVISIT_BYTES else digest
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID_MARK}{shown}:{named}>"),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields.append(("WARC-Profile", PROFILE))
        fields.append(("WARC-Refers-To", f"<{ID_MARK}{'' if first is None else first}:{digest}>"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + header_lines(fields) + b"\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """Streams records into one package; holds a line of index for each."""

    def __init__(self, sink, level: int = 3):
        from zipfile import ZIP_STORED, ZipFile

        self.package = ZipFile(sink, "w", ZIP_STORED, allowZip64=True)
        self.archive = self.package.open(ARCHIVE, "w", force_zip64=True)
        self.level, self.at, self.lines = level, 0, []

    def add(self, key: str, *cells) -> None:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = pack.compress(record(f"{key}-{len(self.lines)}", *cells)) + pack.flush()
        self.archive.write(data)
        shown = "-" if cells[0] is None else cells[0]
        self.lines.append(f"{shown} {self.at} {len(data)}\n")
        self.at += len(data)

    def close(self) -> None:
        self.archive.close()
        with self.package.open(INDEX, "w", force_zip64=True) as index:
            for start in range(0, len(self.lines), 4096):
                index.write("".join(self.lines[start : start + 4096]).encode())
        self.package.close()


def write_packages(rows: DataFrame, folder: str, most: int = PACKAGE_RECORDS) -> DataFrame:
    """Write typed rows below ``folder``; returns the manifest, already materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, writer, sink = TaskContext.get(), [], None, None
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"

        def finish() -> None:
            writer.close()
            size = sink.tell()
            sink.close()
            done.append((path, len(writer.lines), size))

        for batch in slices(batches, "body"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "revisit", "first")]
            for cells in zip(*columns, strict=True):
                if writer is None:
                    path = f"{folder}/{attempt}-{len(done):04d}.zip"
                    files, at = open_shared(path)
                    files.create_dir(at.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(at)
                    writer = PackageWriter(sink)
                writer.add(f"{attempt}-{len(done)}", *cells)
                if len(writer.lines) == most:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield arrow_batch(["path", "n_records", "n_bytes"], [pa.string(), pa.int64(), pa.int64()], list(zip(*done, strict=True)))

    return staged(rows.select("page_id", "url", "body", "digest", "revisit", "first").mapInArrow(write, PACKAGES), "packages")


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of neighbouring records: where the first begins in the package, and the length of each."""
    from .zip_reader import ZipRanges

    names, types = ["path", "at", "lengths"], [pa.string(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, at = open_shared(path)
            with files.open_input_file(at) as source:
                package = ZipRanges(source)
                archive, spans, lengths, span_at, end = package.start(ARCHIVE), [], [], 0, 0
                for line in package.lines(INDEX):
                    _, place, length = line.split(b" ")
                    place, length = int(place), int(length)
                    if place != end or place + length > package.members[ARCHIVE].size:
                        raise ValueError(f"the index of {path} does not fit its archive")
                    if lengths and (place + length - span_at > SPAN_BYTES or len(lengths) == SPAN_RECORDS):
                        spans.append((path, archive + span_at, lengths))
                        lengths, span_at = [], place
                    lengths.append(length)
                    end = place + length
                    if len(spans) == 256:
                        yield arrow_batch(names, types, list(zip(*spans, strict=True)))
                        spans = []
                if lengths:
                    spans.append((path, archive + span_at, lengths))
                if spans:
                    yield arrow_batch(names, types, list(zip(*spans, strict=True)))


def inflated(data: memoryview) -> Iterator[bytes]:
    """One gzip member in parts."""
    unpack, rest = zlib.decompressobj(31), data
    while not unpack.eof:
        part = unpack.decompress(rest, INFLATE_BYTES)
        rest = unpack.unconsumed_tail
        if part:
            yield part
        elif not rest and not unpack.eof:
            raise ValueError("a record is truncated")
    if unpack.unused_data:
        raise ValueError("a record is shorter than its index says")


def head_of(held: bytearray, parts: Iterator[bytes]) -> list[bytes]:
    """Lines up to the empty one; ``held`` keeps what follows it."""
    while (end := held.find(b"\r\n\r\n")) < 0:
        part = next(parts, None)
        if part is None:
            raise ValueError("a record ends within its header")
        held += part
    lines = bytes(held[:end]).split(b"\r\n")
    del held[: end + 4]
    return lines


def named_fields(lines: list[bytes]) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (line.decode().partition(":") for line in lines)}


def page_of(urn: str) -> int | None:
    shown = urn.strip("<>").removeprefix(ID_MARK).partition(":")[0]
    return int(shown) if shown else None


def parse_record(data: memoryview) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to; payloads are hashed in parts, never held."""
    parts, held = inflated(data), bytearray()
    version, *lines = head_of(held, parts)
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = named_fields(lines)
    length = int(fields["content-length"])
    kind, url = fields["warc-type"], fields.get("warc-target-uri")
    declared = fields["warc-payload-digest"].removeprefix("sha256:")
    before = len(held)
    read = 0

    def counted() -> Iterator[bytes]:
        nonlocal read
        for part in parts:
            read += len(part)
            yield part

    rest = counted()
    _, *lines = head_of(held, rest)
    full = int(named_fields(lines)["content-length"])
    left = length - (before + read - len(held))
    digest, taken = sha256(), min(left, len(held))
    digest.update(memoryview(held)[:taken])
    tail = bytes(held[taken:])
    left -= taken
    for part in rest:
        here = min(left, len(part))
        digest.update(memoryview(part)[:here])
        left -= here
        tail += part[here:]
    if left or tail != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    if kind == "response" and digest.hexdigest() != declared:
        raise ValueError("a payload does not have its digest")
    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_of(fields["warc-record-id"]), url, full, declared, kind, refers


def read_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, start, lengths in zip(*[batch.column(c).to_pylist() for c in ("path", "at", "lengths")], strict=True):
            files, at = open_shared(path)
            with files.open_input_file(at) as source:
                source.seek(start)
                data, rows = memoryview(source.read(sum(lengths))), []
                for length in lengths:
                    rows.append(parse_record(data[:length]))
                    data = data[length:]
            yield arrow_batch(names, types, list(zip(*rows, strict=True)))


def read_packages(packages: DataFrame) -> DataFrame:
    """Per record, from the files: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    n, size = packages.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).head()
    # Explicit numbers of tasks, since Spark would join such small rows into one.
    spans = staged(packages.select("path").repartitionByRange(max(1, n), "path").mapInArrow(locate, SPANS), "spans")
    parallel = packages.sparkSession.sparkContext.defaultParallelism
    return spans.repartitionByRange(max(parallel, size // READ_BYTES), "path", "at").mapInArrow(read_spans, RECORDS)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rows = typed(pages)
    return read_packages(write_packages(rows, shared_path(spark, "packages")))
