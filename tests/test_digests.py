"""Digests of trace files: streamed, kept in a table, bound by one root."""

import hashlib
import json

import pytest

from poolwise.contracts import Trace
from poolwise.sources import store
from poolwise.sources.tables import trace_from_tables

SF = "/root/testdata/sf0.001"


def test_a_sparse_file_beyond_two_gigabytes_is_hashed(spark, tmp_path):
    size = 3 << 30
    folder = tmp_path / "jobs"
    folder.mkdir()
    with open(folder / "part-0.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 7)
        f.write(b"the end")
    (folder / "part-1.bin").write_bytes(b"one")
    (folder / "other").write_bytes(b"x")
    want = hashlib.sha256()
    for _ in range(size // (64 << 20) - 1):
        want.update(bytes(64 << 20))
    want.update(bytes((64 << 20) - 7) + b"the end")
    rows = {r.name: (r.size, r.sha256) for r in store.file_digests(spark, str(folder)).collect()}
    assert rows == {"jobs/part-0.bin": (size, want.hexdigest()), "jobs/part-1.bin": (3, hashlib.sha256(b"one").hexdigest())}


def test_the_root_depends_on_every_row_and_on_no_order(spark):
    rows = [(f"jobs/part-{i}", i, f"{i:064x}") for i in range(500)]
    frame = lambda r: spark.createDataFrame(r, store.DIGESTS)
    first = store.digest_root(frame(rows))
    assert first[:2] == (500, sum(range(500)))
    assert store.digest_root(frame(rows[::-1]).repartition(7)) == first
    for changed in (rows[:-1], [*rows, ("jobs/part-x", 0, "0" * 64)], [(rows[0][0], 1, rows[0][2]), *rows[1:]], [("jobs/part-y", *rows[0][1:]), *rows[1:]]):
        assert store.digest_root(frame(changed))[2] != first[2]


@pytest.mark.parametrize("data_format", ["parquet", "csv"])
def test_a_flipped_byte_names_its_file(spark, tmp_path, data_format):
    full = trace_from_tables(spark, SF)
    trace = Trace(full.nodes.repartition(3), full.jobs, full.trace_id, full.time_origin)
    root = str(tmp_path / "trace")
    manifest = store.write_trace(spark, root, trace, {"dataset": "x"}, data_format=data_format)
    assert set(manifest["files"]) == {"table", "count", "bytes", "root"}
    assert len(json.dumps(manifest)) < 700
    target = sorted((tmp_path / "trace" / "jobs").glob("part-*"))[0]
    data = bytearray(target.read_bytes())
    data[len(data) // 2] ^= 1
    target.write_bytes(bytes(data))
    (target.parent / f".{target.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match=target.name):
        store.read_trace(spark, root)
    data[len(data) // 2] ^= 1
    target.write_bytes(bytes(data))
    assert store.read_trace(spark, root).jobs.count() == full.jobs.count()
    extra = target.parent / f"part-zzz.{data_format}"
    extra.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="part-zzz"):
        store.read_trace(spark, root)


def test_a_changed_digest_table_is_refused(spark, tmp_path):
    full = trace_from_tables(spark, SF)
    root = str(tmp_path / "trace")
    store.write_trace(spark, root, full, {"dataset": "x"}, verify=False)
    table = spark.read.parquet(f"{root}/{store.DIGEST_TABLE}")
    rows = table.collect()
    spark.createDataFrame([(r.name, r.size + 1, r.sha256) for r in rows], store.DIGESTS).write.mode("overwrite").parquet(f"{root}/{store.DIGEST_TABLE}")
    with pytest.raises(ValueError, match="digest table"):
        store.read_trace(spark, root)
