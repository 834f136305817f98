"""Real files: conditions judged where they lie, hashing in stages, totals counted on the way."""

from __future__ import annotations

import contextlib
import hashlib
import io
import os
import re
import threading
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fileledger.operators.enrich import hash_in_stages
from fileledger.operators.reports import find_empty, find_large
from fileledger.operators.scan import scan_inventory, scan_into, scan_totals
from fileledger.sources import content
from fileledger.sources.directory import FORMAT, TreeReader, list_tree, list_where, register
from fileledger.sources.walk import on_the_way


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    bodies = {f"a/{k}.bin": bytes([k]) * k * 10 for k in range(30)} | {"b/c/deep.txt": b"x" * 500, "b/d.txt": b"", ".h": b"1"}
    for name, body in bodies.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    (root / "broken").symlink_to(root / "missing")
    os.utime(root / "b/d.txt", (1000, 2000))
    return root


CONDITIONS = [
    "size >= 100", "size > 100 and size < 200", "size = 0", "size <= 40 and is_file", "not size = 0", "size is null",
    "error is null and size is not null", "mtime > 1500", "atime < 1500.5", "size in (10, 20, 500)", "size not in (10, 20)",
    "path like '%.txt'", "path like '%/b/%'", "size > 10 or size = 0", "is_symlink", "size is null or size > 100", "size + 1 > 100",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_same_rows_as_spark_would_choose(spark, tree, condition):
    register(spark)
    # `list_tree` pushes nothing. Walking through the directories changes no file's times but theirs.
    pushed = spark.read.format(FORMAT).load(str(tree)).filter(condition).select("path", "size", "mtime", "is_file")
    plain = list_tree(spark, str(tree), 2).filter(condition).select("path", "size", "mtime", "is_file")
    assert sorted(map(tuple, pushed.collect())) == sorted(map(tuple, plain.collect()))


def test_conditions_reach_the_source(spark, tree):
    register(spark)
    listing = spark.read.format(FORMAT).load(str(tree))
    files = scan_inventory(listing).withColumn("file_id", F.xxhash64("path"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        find_large(files, 150).explain("formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", out.getvalue())[1]
    assert "GreaterThanOrEqual(size,150)" in pushed and "IsNull(error)" in pushed
    assert not re.search("Condition .*size", out.getvalue())
    assert {r.name for r in find_large(files, 150).collect()} == {f"{k}.bin" for k in range(15, 30)} | {"deep.txt"}
    assert {r.name for r in find_empty(files).collect()} == {"0.bin", "d.txt"}


def test_rejected_files_are_not_sent_and_paths_not_looked_at(tree, monkeypatch):
    from pyspark.sql.datasource import GreaterThan, StringStartsWith

    import fileledger.sources.directory as directory

    seen = []
    given = directory.stat_row
    monkeypatch.setattr(directory, "stat_row", lambda path, error=None: seen.append(path) or given(path, error))
    reader = TreeReader({"path": str(tree)})
    left = list(reader.pushFilters([StringStartsWith(("path",), f"{tree}/b/"), GreaterThan(("size",), 3)]))
    assert left == []
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert [row[0] for row in rows] == [f"{tree}/b/c/deep.txt"]
    assert sorted(seen) == [f"{tree}/b/c/deep.txt", f"{tree}/b/d.txt"]


def test_directories_on_the_way():
    assert on_the_way("/a", "") and on_the_way("/a", "/a/b/") and on_the_way("/a/b/c", "/a/b/") and on_the_way("/a/bc", "/a/b")
    assert not on_the_way("/a/c", "/a/b/") and not on_the_way("/b", "/a/b")


def test_list_where(spark, tree):
    def names(**bounds):
        return {os.path.relpath(r.path, tree) for r in list_where(spark, str(tree), **bounds).collect()}

    assert names(min_size=280) == {"a/28.bin", "a/29.bin", "b/c/deep.txt"}
    assert names(min_size=10, max_size=20) == {"a/1.bin", "a/2.bin"} | ({"broken"} & names(min_size=10, max_size=20))
    assert names(below=str(tree / "b")) == {"b/c/deep.txt", "b/d.txt"}
    assert names(accessed_before=datetime(1971, 1, 1)) == {"b/d.txt"}
    assert "b/d.txt" not in names(modified_after=datetime(1971, 1, 1)) and "a/3.bin" in names(modified_after=datetime(1971, 1, 1))


def test_stages_find_the_copies_of_full_hashing(spark, tmp_path):
    block = 64
    long = os.urandom(1000)
    bodies = [long, long, long[:500] + b"?" + long[501:], os.urandom(1000), b"x" * 100, b"x" * 100, b"y" * 100, b"", b"", b"only" * 77, os.urandom(128), os.urandom(129)]
    rows = []
    for k, body in enumerate(bodies):
        (tmp_path / str(k)).write_bytes(body)
        rows.append((k, str(tmp_path / str(k)), len(body)))
    rows += [(50, str(tmp_path / "gone"), 1000), (51, str(tmp_path / "0"), None)]
    files = spark.createDataFrame(rows, "file_id bigint, path string, size bigint")
    for slice_rows in (1, 1000):
        found = {r.file_id: r for r in hash_in_stages(files, 3, block, slice_rows).collect()}
        assert len(found) == len(rows)
        full = {k: hashlib.sha256(body).hexdigest() for k, body in enumerate(bodies)} | {51: hashlib.sha256(long).hexdigest()}
        copies = Counter(full.values())
        for k, r in found.items():
            assert r.sha256 in (None, full.get(k)) and (copies[full.get(k)] < 2 or r.sha256)
        assert found[50].sha256 is None and "gone" in found[50].error
        assert all(r.error is None for k, r in found.items() if k != 50)
        # Sizes of their own are not opened, other starts not read whole, small files read once.
        assert found[9].bytes_read == found[10].bytes_read == found[11].bytes_read == 0
        assert found[3].bytes_read == 2 * block and found[4].bytes_read == 100
        assert [found[k].bytes_read for k in (0, 1, 2)] == [1000 + 2 * block] * 3
    assert hash_in_stages(files.limit(0)).count() == 0


def test_a_task_reads_a_few_files_at_once(tmp_path):
    now, most, lock = 0, 0, threading.Lock()
    ready = threading.Barrier(3, timeout=20)

    def work(path):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        ready.wait()
        with lock:
            now -= 1
        if path == "4":
            raise OSError("no")
        return {"n": path}

    found = list(content.in_advance(work, map(str, range(9)), 3))
    assert most == 3
    assert found == [({"n": str(k)}, None) if k != 4 else ({}, "no") for k in range(9)]
    ready = threading.Barrier(1)
    assert len(list(content.in_advance(work, map(str, range(5)), 1))) == 5


def test_totals_are_counted_while_files_are_added(spark, tree, tmp_path):
    files = scan_inventory(list_where(spark, str(tree)))
    ticks = iter([datetime(2026, 1, 1), datetime(2026, 1, 1) + timedelta(seconds=7)] * 2)
    path = str(tmp_path / "inventory")
    first = scan_into(files, path, clock=lambda: next(ticks))
    assert (first.total_files, first.total_bytes) == tuple(scan_totals(files).first())
    assert first.duration_seconds == 7 and first.added.count() == first.total_files
    again = scan_into(files, path, clock=lambda: next(ticks))
    assert (again.total_files, again.total_bytes) == (first.total_files, first.total_bytes)
    assert again.added.count() == 0
    assert scan_into(files.filter(F.lit(False)), str(tmp_path / "none")).total_bytes == 0
