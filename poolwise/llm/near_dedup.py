"""MinHash near-deduplication on fast similarity sketches.

1. Each split computes shingle sets and sketches (``fast_sketch.py``). Of rows with the same set, only
   the split's first carries the sketch on; carriers with the same set form a class, represented by
   its smallest row. A hot group of copies is one row per split before any shuffle.
2. Banding: representatives meet in buckets by the bins of a band. With 48 bands of 4 bins, a pair at
   similarity 0.75 shares no bucket with probability 1.2e-8. Buckets with equal members count once.
3. Inside a bucket, a breadth-first search compares whole signatures with the members not yet reached, so a bucket
   gives at most as many edges as members. Pairs under an estimate of 0.55 are left out: over six
   standard deviations below 0.75. What these edges connect is a candidate group; every link lies in one.
4. Exact verification: texts of a candidate group meet, and the same search runs on the full shingle sets
   with 100 * intersection >= 75 * union. Its edges give the components.

Buckets and candidate groups over ``CELL`` members are not capped: their members are dealt to chunks,
and every pair of chunks meets in a cell of its own, so every pair is still compared, memory stays bounded and
the work spreads over tasks. Such a group costs as many copies of its rows as it has chunks.

Defined results: null, empty and wordless texts have no shingles, no link, and are kept; repeated rows
share their set and so their component. A component's smallest doc_id names it; null doc_ids sort last. Of rows that
repeat this doc_id the one read first is kept, so exactly one row of a component is. Further columns are ignored; an
empty table gives no rows. Shingles count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices, staged, text_bytes, text_key
from .components import components

BANDS, ROWS = 48, 4
BINS = BANDS * ROWS
ESTIMATE = 0.55
CELL = 2048
CARRIERS_HELD = 100_000

SKETCHED = "row_id long, doc_id long, text_key long, n_shingles long, carrier long, set_hash binary, bands array<long>, signature binary, body binary"


def sketch_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    from .fast_sketch import band_keys, signatures, sketches
    from .shingles import shingle_sets

    names = [f.split()[0] for f in SKETCHED.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    first: dict[bytes, int] = {}
    for batch in slices(batches, "body"):
        bodies, rows = batch.column("body").to_pylist(), batch.column("row_id").to_pylist()
        values, bounds = shingle_sets(bodies)
        sizes = np.diff(bounds)
        carriers: list[int | None] = []
        fresh: list[int] = []
        hashes: list[bytes | None] = [None] * len(rows)
        for i, row in enumerate(rows):
            if not sizes[i]:
                carriers.append(None)
                continue
            digest = xxhash.xxh3_128_digest(values[bounds[i] : bounds[i + 1]].tobytes())
            carrier = first.setdefault(digest, row)
            carriers.append(carrier)
            if carrier == row:
                fresh.append(i)
                hashes[i] = digest
        chosen = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in fresh]) if fresh else values[:0]
        table = sketches(chosen, np.concatenate([[0], np.cumsum(sizes[fresh])]).astype(np.int64), BINS)
        keys, signs = band_keys(table, ROWS).view(np.int64), signatures(table)
        bands: list = [None] * len(rows)
        signature: list = [None] * len(rows)
        carried: list = [None] * len(rows)
        for k, i in enumerate(fresh):
            bands[i], signature[i], carried[i] = keys[k], signs[k].tobytes(), bodies[i]
        cells = [batch.column("row_id"), batch.column("doc_id"), batch.column("text_key"), sizes, carriers, hashes, bands, signature, carried]
        yield arrow_batch(names, types, cells)
        if len(first) > CARRIERS_HELD:
            first = {}


def full_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has several members; ``members`` is a hash of the set of them."""
    from .shingles import mix

    names, types = ["key", "rep", "members", "n"], [pa.int64()] * 4
    key_left, rep_left = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        if not len(keys):
            return arrow_batch(names, types, [[]] * 4)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        members = np.add.reduceat(mix(reps.view(np.uint64)), starts).view(np.int64)
        n = np.repeat(sizes, sizes)
        chosen = n > 1
        return arrow_batch(names, types, [keys[chosen], reps[chosen], np.repeat(members, sizes)[chosen], n[chosen]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([key_left, batch.column("key").to_numpy()])
        reps = np.concatenate([rep_left, batch.column("rep").to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1]))
        key_left, rep_left = keys[cut:], reps[cut:]
        yield out(keys[:cut], reps[:cut])
    yield out(key_left, rep_left)


def in_cells(members: DataFrame, group: str) -> DataFrame:
    """Adds ``cell``: a group of at most CELL members is one cell; of a larger one, each pair of chunks."""
    chunks = F.ceil(F.col("n") / F.lit(CELL)).cast("long")
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), chunks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    dealt = members.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", other)
    return dealt.withColumn("cell", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))).drop("chunks", "mine", "other")


def by_cell(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list, ...]]:
    """The rows of one cell after another, from rows sorted by cell."""
    current, held = None, tuple([] for _ in columns)
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        for cell, *row in zip(batch.column("cell").to_pylist(), *lists, strict=True):
            if cell != current:
                if current is not None:
                    yield held
                current, held = cell, tuple([] for _ in columns)
            for kept, value in zip(held, row, strict=True):
                kept.append(value)
    if current is not None:
        yield held


def search(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest: ``near(x, rest)`` says which of ``rest`` link with ``x``."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            linked = near(x, rest)
            for y in rest[linked].tolist():
                queue.append(y)
                yield x, y
            rest = rest[~linked]


EDGES = "u long, v long"


def estimated_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = int(np.ceil(ESTIMATE * BINS))
    for reps, signs in by_cell(batches, ("rep", "signature")):
        table = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), BINS)
        edges = [(reps[a], reps[b]) for a, b in search(len(reps), lambda x, rest: (table[rest] == table[x]).sum(axis=1) >= least)]
        if edges:
            yield arrow_batch(["u", "v"], [pa.int64()] * 2, list(zip(*edges, strict=True)))


def verified_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .shingles import shingle_sets

    for reps, bodies in by_cell(batches, ("rep", "body")):
        values, bounds = shingle_sets(bodies)
        n, sizes = len(reps), np.diff(bounds)
        _, token, count = np.unique(values, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(token, kind="stable")
        posting, starts = owner[order], np.concatenate([[0], np.cumsum(count)])

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            mine = token[bounds[x] : bounds[x + 1]]
            mine = mine[count[mine] > 1]
            lengths = count[mine]
            total = int(lengths.sum())
            if not total:
                return np.zeros(len(rest), bool)
            skip = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            shared = np.bincount(posting[np.arange(total) + skip], minlength=n)[rest]
            return 100 * shared >= 75 * (sizes[x] + sizes[rest] - shared)

        edges = [(reps[a], reps[b]) for a, b in search(n, near)]
        if edges:
            yield arrow_batch(["u", "v"], [pa.int64()] * 2, list(zip(*edges, strict=True)))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_key."""
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        text_bytes().alias("body"),
    )
    sketched = staged(read.mapInArrow(sketch_pass, SKETCHED), "sketches")
    carriers = sketched.where(F.col("bands").isNotNull())

    # Classes of equal sets; a class is named by its smallest carrier.
    named = carriers.select("carrier", "set_hash")
    classes = named.join(named.groupBy("set_hash").agg(F.min("carrier").alias("rep")), "set_hash").select("carrier", "rep")
    reps = classes.where("carrier = rep").select("rep")
    of_reps = carriers.withColumnRenamed("carrier", "rep").join(reps, "rep", "left_semi")

    banded = of_reps.select("rep", F.explode("bands").alias("key"))
    full = staged(
        banded.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(full_buckets, "key long, rep long, members long, n long"),
        "buckets",
    )
    chosen = full.groupBy("members", "n").agg(F.min("key").alias("key"))
    buckets = full.join(chosen, ["members", "n", "key"], "left_semi")
    estimated = (
        in_cells(buckets.join(carriers.select(F.col("carrier").alias("rep"), "signature"), "rep"), "key")
        .select("cell", "rep", "signature")
        .repartition("cell")
        .sortWithinPartitions("cell", "rep")
        .mapInArrow(estimated_edges, EDGES)
    )
    grouped = components(estimated)

    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"))
    members = grouped.join(sizes, "component").withColumnRenamed("node", "rep")
    verified = (
        in_cells(members, "component")
        .select("cell", "rep")
        .join(carriers.select(F.col("carrier").alias("rep"), "body"), "rep")
        .repartition("cell")
        .sortWithinPartitions("cell", "rep")
        .mapInArrow(verified_edges, EDGES)
    )
    linked = components(verified)

    group = F.coalesce("component", "rep")
    answer = classes.join(linked, classes.rep == linked.node, "left").select("carrier", group.alias("group"))
    rows = sketched.select("row_id", "doc_id", "text_key", "n_shingles", "carrier")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id"))
    per_carrier = rows.where("carrier IS NOT NULL").groupBy("carrier").agg(first.alias("least")).join(answer, "carrier")
    least = per_carrier.groupBy("group").agg(F.min("least").alias("least"))
    found = per_carrier.select("carrier", "group").join(least, "group").select("carrier", "least")
    return rows.join(found, "carrier", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("carrier").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (F.col("carrier").isNull() | (F.col("row_id") == F.col("least.row_id"))).alias("kept"),
        "text_key",
    )
