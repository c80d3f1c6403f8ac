"""Arrays read by ranges equal arrays read whole; damage raises, wherever the cuts fall."""

import io
import json
import random

import pytest

from poolwise.sources import importers
from poolwise.sources.json_array import Damaged, count_range, read_json_array, records_of


def by_ranges(data, step):
    """All records, as the ranges of ``step`` bytes yield them."""
    out, in_string, depth = [], 0, 0
    for start in range(0, max(1, len(data)), step):
        end = min(len(data), start + step)
        out += records_of(io.BytesIO(data), start, end, len(data), in_string, depth)
        quotes, outside, inside = count_range(io.BytesIO(data), start, end)
        depth += inside if in_string else outside
        in_string = (in_string + quotes) % 2
    return out


def odd_records():
    rng = random.Random(3)
    pieces = ['"', "\\", "{", "}", "[", "]", ",", " ", "é", '\\"', "\\\\", "\n", "x"]
    yield from [{}, {"a": ""}, {"a": "}]\"{["}, {"a": "\\"}, {"a": "\\\\\\\""}, {"a": [[{}], [{"b": "]"}]]}]
    for _ in range(40):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        yield {text: text, "n": [{"k": text[::-1]}] * rng.randint(0, 3)}


@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_gives_the_same_records(indent):
    records = list(odd_records())
    data = (" \n" + json.dumps(records, ensure_ascii=False, indent=indent) + "\n ").encode()
    for step in [*range(1, 40), 1000, len(data) - 1, len(data) + 5]:
        assert [json.loads(r) for r in by_ranges(data, step)] == records
    assert by_ranges(b" [ ] ", 2) == []


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "{}", "[", "[{}", '[{"a": 1}, ]', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', "[1]", "[[{}]]", '[{"a": 1}] x', '[{"a": 1}]]',
        '[{"a": "x}]', '[{"a": 1}, "b"]', "x[{}]", '[{"a": 1}][{"a": 2}]', '[, {"a": 1}]', '[{"a": 1}, null]', '[{"a": 1}}',
    ],
)
def test_damaged_arrays_raise(text):
    data = text.encode()
    for step in range(1, len(data) + 2):
        with pytest.raises(Damaged):
            by_ranges(data, step)


RECORD = {
    "jobid": "j {0} \\\" [",
    "submitted_time": "2024-01-01 00:00:00",
    "attempts": [{"start_time": "2024-01-01 00:00:00", "end_time": "None", "detail": [{"ip": "1.2.3.4", "gpus": ["g{", "]"]}]}],
}


def test_ranges_equal_the_whole_file(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for k, indent in enumerate((None, 1)):
        records = [{**RECORD, "jobid": f"{k}-{i} \" }} \\"} for i in range(400)]
        (folder / f"{k}.json").write_text(json.dumps(records, indent=indent))
    whole = spark.read.schema(importers.ATTEMPT_LOG).json(str(folder), multiLine=True, mode="FAILFAST")
    parts = read_json_array(spark, str(folder), importers.ATTEMPT_LOG, range_bytes=5000)
    assert parts.rdd.getNumPartitions() > 20
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert parts.schema == whole.schema


def test_broken_records_raise(spark, tmp_path):
    for name, text in (("cut", '[{"jobid": "1"}, {"jobid": "2"'), ("type", '[{"jobid": "1", "attempts": 5}]'), ("syntax", '[{"jobid" "1"}]')):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="does not end|MALFORMED|FAILFAST|Malformed"):
            read_json_array(spark, str(tmp_path / f"{name}.json"), importers.ATTEMPT_LOG).collect()
