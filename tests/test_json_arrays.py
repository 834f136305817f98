"""JSON arrays in ranges of bytes give the records of the whole."""

from __future__ import annotations

import io
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fileledger.sources import json_arrays
from fileledger.sources.json_arrays import read_arrays

KIND = "id bigint, t string, o struct<a:array<string>>"


def make_records(seed: int, count: int) -> list[dict]:
    pick = random.Random(seed)
    odd = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", '{"x":[', "é", "日本", "\n", "", "a" * 50, "😀", ","]
    text = lambda: "".join(pick.choices(odd, k=pick.randrange(8)))
    return [{"id": k, "t": text(), "o": {"a": [text() for _ in range(pick.randrange(4))]}} for k in range(count)]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent, ascii_only", [(None, True), (2, False)])
def test_ranges_give_each_record_once(range_bytes, indent, ascii_only):
    records = make_records(range_bytes, 40)
    mixed = [1, "no {object}", None, [{"id": -1}], *records, [[]], "]"]
    raw = json.dumps(mixed, indent=indent, ensure_ascii=ascii_only).encode() + b"\n"
    file = pa.PythonFile(io.BytesIO(raw), "r")
    found, inside, depth = [], False, 0
    for start in range(0, len(raw), range_bytes):
        stop = min(len(raw), start + range_bytes)
        found += [json.loads(x) for x in json_arrays._records(file, start, stop, inside, depth, step=13)]
        before = json_arrays._backslashes_before(file, start)
        outside, depths = json_arrays.scanned(np.frombuffer(raw[start:stop], np.uint8), before, inside, depth)
        inside, depth = not outside[-1], int(depths[-1])
    assert found == records


@pytest.mark.parametrize("range_bytes", [50, 3000, 1 << 20])
def test_read_arrays(spark, tmp_path, range_bytes):
    want = []
    for k, count in enumerate([0, 1, 30]):
        records = make_records(k, count)
        want += records
        (tmp_path / f"{k} é.json").write_text(json.dumps(records, ensure_ascii=k == 1), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    found = read_arrays(spark, str(tmp_path), KIND, range_bytes)
    got = [r.asDict(recursive=True) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_little_is_read_behind_a_range():
    """All ranges together read a few times the file, however long it is, and a long record takes few reads."""
    records = [{"id": k, "t": "x" * (200_000 if k == 1000 else 100)} for k in range(5000)]
    raw = json.dumps(records).encode()

    class Counted(io.BytesIO):
        reads = sizes = 0

        def read(self, size):
            part = super().read(size)
            self.reads, self.sizes = self.reads + 1, self.sizes + len(part)
            return part

    file, found, depth, inside, size = Counted(raw), [], 0, False, 2000
    for start in range(0, len(raw), size):
        stop = min(len(raw), start + size)
        found += [json.loads(x) for x in json_arrays._records(file, start, stop, inside, depth)]
        outside, depths = json_arrays.scanned(np.frombuffer(raw[start:stop], np.uint8), 0, inside, depth)
        inside, depth = not outside[-1], int(depths[-1])
    assert found == records
    assert file.sizes < 6 * len(raw)
    assert file.reads < 3 * (len(raw) / size + 1) + 10


def test_array_report_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task gets the whole report: each writes an array of its own."""
    from fileledger.catalog import queries

    texts = [(k, f"text {k % 200}", "en", "s", 8) for k in range(1, 1001)]
    layout = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(texts, layout).write.parquet(str(tmp_path / "documents.parquet"))
    folders = []
    read = queries.read_arrays
    monkeypatch.setattr(queries, "read_arrays", lambda s, path, *a, **b: (folders.append(path), read(s, path, *a, **b))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.report_items_of_array(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    copies = [k for k, *_ in texts if k > 200]
    empty = [k + 1_000_000_000 for k in range(50, 1001, 50)]
    ids = sorted(r.file_id for r in found)
    assert len(ids) == len(set(ids)) == len(copies) + len(empty) - 1
    written = [json.loads(x.value) for x in spark.read.text(folders[0], wholetext=True).collect() if x.value]
    assert len(written) > 3
    assert sum(len(x) - 1 for x in written) == len(ids)


def test_a_large_array_gives_several_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"id": k, "t": "x" * 100} for k in range(5000)]))
    found = read_arrays(spark, str(path), KIND, 1 << 16)
    assert found.count() == 5000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
