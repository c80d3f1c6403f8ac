"""A JSON array of records, read by byte ranges.

``multiLine`` gives a whole file to one task. Here a file is cut into ranges whatever its layout, and a
range needs to know two things about its first byte: whether it lies in a string, and how deep.

1. Each range counts its unescaped quotes and its brackets, the latter twice: as if it began outside and
   as if it began inside a string. A task reads its range in pieces; nothing but three numbers leaves it.
2. The state at the start of a range is the parity of all quotes before it, and then the sum of the
   bracket counts that belong to each earlier range's parity: two running sums over one row per range.
3. A range yields the records that begin in it, reading on to the end of the last one. Whatever
   lies between records must be one comma, before the first and behind the last nothing but the
   array's brackets. Spark parses the records with the declared schema and refuses broken ones.

A task holds a piece and the record it is reading. Files are UTF-8, as JSON demands. A file that is not
an array, is cut off, or holds anything but records raises ``ValueError``, naming the file and the place;
a file without a single byte gives no rows, as it does with ``multiLine``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package
from .files import listed, open_file

RANGE_BYTES = 64 << 20
PIECE_BYTES = 4 << 20
OUT_BYTES = 4 << 20
SPACE = b" \t\r\n"

QUOTE, BACKSLASH = ord('"'), ord("\\")
OPENING, CLOSING = (ord("{"), ord("[")), (ord("}"), ord("]"))

COUNTS = "path string, length long, start long, `end` long, quotes long, outside long, inside long"


def escaped_at(source, place: int) -> bool:
    """Whether an odd number of backslashes stands right before ``place``."""
    run, part = 0, 1
    while place > 0:
        part = min(64, place)
        source.seek(place - part)
        held = source.read(part)
        kept = held.rstrip(b"\\")
        run, place = run + len(held) - len(kept), place - part
        if kept:
            break
    return run % 2 == 1


def unescaped_quotes(piece: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """A mask of the quotes that open or close strings, and whether the byte after the piece is escaped."""
    quotes, back = piece == QUOTE, piece == BACKSLASH
    if not escaped and not back.any():
        return quotes, False
    places = np.arange(len(piece))
    last_other = np.maximum.accumulate(np.where(back, -1, places))
    run = places - last_other + ((last_other < 0) & escaped)
    before = np.concatenate([[int(escaped)], run[:-1]])
    return quotes & (before % 2 == 0), bool(len(piece) and run[-1] % 2)


def brackets(piece: np.ndarray) -> np.ndarray:
    """+1 where a bracket opens, -1 where one closes."""
    steps = np.zeros(len(piece), np.int8)
    steps[(piece == OPENING[0]) | (piece == OPENING[1])] = 1
    steps[(piece == CLOSING[0]) | (piece == CLOSING[1])] = -1
    return steps


def pieces_of(source, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    source.seek(start)
    at = start
    while at < size and (data := source.read(min(PIECE_BYTES, size - at))):
        yield at, data
        at += len(data)


def count_range(source, start: int, end: int) -> tuple[int, int, int]:
    escaped = escaped_at(source, start)
    quotes = outside = inside = 0
    for _, data in pieces_of(source, start, end):
        piece = np.frombuffer(data, np.uint8)
        marks, escaped = unescaped_quotes(piece, escaped)
        parity = (np.cumsum(marks) - marks + quotes) & 1
        steps = brackets(piece)
        outside += int(steps[parity == 0].sum())
        inside += int(steps[parity == 1].sum())
        quotes += int(marks.sum())
    return quotes, outside, inside


class Damaged(ValueError):
    pass


def records_of(source, start: int, end: int, size: int, in_string: int, depth: int) -> Iterator[bytes]:
    """The records that begin in [start, end) of an array of ``size`` bytes."""
    mode = "head" if start == 0 else "seek"
    escaped, parts, gap, at = escaped_at(source, start), [], b"", 0

    def fail(place: int, what: str):
        raise Damaged(f"byte {place}: {what}")

    for at, data in pieces_of(source, start, size):
        if mode == "seek" and at >= end:
            return
        piece, cursor = np.frombuffer(data, np.uint8), 0
        marks, escaped = unescaped_quotes(piece, escaped)
        parity = (np.cumsum(marks) - marks + in_string) & 1
        in_string = (in_string + int(marks.sum())) & 1
        steps = np.where(parity == 0, brackets(piece), 0)
        places = np.flatnonzero(steps)
        after = depth + np.cumsum(steps[places], dtype=np.int64)
        depth = int(after[-1]) if len(after) else depth
        opens = steps[places] > 0
        level = np.where(opens, after - 1, after)
        shallow = level <= 1
        for place, opening, low in zip(places[shallow].tolist(), opens[shallow].tolist(), level[shallow].tolist(), strict=True):
            if mode == "seek" and at + place >= end:
                return
            between = gap + data[cursor:place] if mode in ("head", "first", "gap", "tail") else b""
            if low < 1 and mode == "seek":
                continue
            if low < 0 or mode == "tail":
                fail(at + place, "text behind the array")
            if low == 0 and opening:
                if mode != "head" or between.strip(SPACE) or data[place : place + 1] != b"[":
                    fail(at + place, "the file is not an array of records")
                mode, gap, cursor = "first", b"", place + 1
            elif low == 0:
                if mode not in ("first", "gap") or between.strip(SPACE) or data[place : place + 1] != b"]":
                    fail(at + place, "the array does not end behind a record")
                mode, gap, cursor = "tail", b"", place + 1
            elif opening:
                if mode in ("first", "gap"):
                    if between.strip(SPACE) != (b"," if mode == "gap" else b""):
                        fail(at + place, "records are not parted by one comma")
                    if at + place >= end:
                        return
                if data[place : place + 1] != b"{":
                    fail(at + place, "an element is not a record")
                mode, parts, cursor = "in", [], place
            elif mode == "in":
                parts.append(data[cursor : place + 1])
                yield b"".join(parts)
                mode, parts, gap, cursor = "gap", [], b"", place + 1
        if mode == "in":
            parts.append(data[cursor:])
        elif mode != "seek":
            gap = (gap + data[cursor:]).strip(SPACE)
            if mode == "tail" and gap:
                fail(at, "text behind the array")
    if mode not in ("tail", "seek"):
        fail(size, "the array does not end")


def array_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """path, length, start, end, in_string, depth of each range; one row per range, stored."""
    step = F.lit(range_bytes)
    files = listed(spark, path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step.cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + step, "length"))
    n = ranges.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with open_file(row["path"]) as source:
                    found.append(count_range(source, row["start"], row["end"]))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "quotes", "outside", "inside"])

    # A number of tasks of its own, since Spark would join such small rows into one.
    counted = ranges.repartitionByRange(max(1, n), "path", "start").mapInArrow(count, COUNTS)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parity = counted.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), zero) % 2)
    own = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    placed = parity.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(before), zero))
    return cut_lineage(placed.select("path", "length", "start", "end", "in_string", "depth"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of every array at or below ``path``, as ``schema`` declares them."""
    ship_package(spark)
    ranges = array_ranges(spark, path, range_bytes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as source:
                    held, size = [], 0
                    try:
                        for record in records_of(source, row["start"], row["end"], row["length"], row["in_string"], row["depth"]):
                            held.append(record)
                            size += len(record)
                            if size > OUT_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["record"])
                                held, size = [], 0
                    except Damaged as error:
                        raise ValueError(f"{row['path']}: {error}") from None
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["record"])

    texts = ranges.repartitionByRange(max(1, ranges.count()), "path", "start").mapInArrow(parse, "record string")
    return texts.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each partition as one JSON array file, a record a line."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                lines = []
                for text in batch.column(0).to_pylist():
                    lines.append(lead + text)
                    lead = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([lead + "]" if lead == "[" else "]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).mapInArrow(bracketed, "value string").write.text(path)
