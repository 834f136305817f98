"""Directory trees on disk: listing, inventory, resume, hashing, metadata and the stream."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fileledger import (
    append_inventory,
    extract_metadata,
    files_left,
    find_empty,
    find_large,
    find_old,
    hash_files,
    merge_results,
    outcomes_of,
    rejected_files,
    resume_new_files,
    scan,
    scan_inventory,
    scan_totals,
)
from fileledger.operators import ledger as work
from fileledger.operators.ordering import number_rows
from fileledger.schema import LISTING
from fileledger.session import cut_lineage
from fileledger.sources import content
from fileledger.sources.directory import FORMAT, list_tree, register
from fileledger.sources.tables import latest_snapshot, read_inventory, write_snapshot
from fileledger.sources.walk import plan_subtrees
from fileledger.sources.objects import hash_objects
from fileledger.streaming.incremental import ingest_new_files, unread_path

CONTENTS = {
    "test.txt": b"hello world",
    "big.bin": b"x" * 100_000,
    "empty.txt": b"",
    ".hidden": b"h",
    "_underscore.csv": b"a,b\r\n1,2\r\n",
    "sub/with space+plus%41.json": b'{"a": 1}',
    "sub/deep/er/file3.pdf": b"%PDF-1.4 fake content",
    "sub/deep/A.TXT": b"caf\xc3\xa9 \xff\n",
    "sub/deep/copy.txt": b"hello world",
    "flat/é.log": b"1",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in CONTENTS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (root / "nothing here").mkdir()
    (root / "link.txt").symlink_to(root / "test.txt")
    (root / "link_to_dir").symlink_to(root / "sub")
    (root / "broken").symlink_to(root / "missing")
    os.mkfifo(root / "pipe")
    return root


def full(root) -> set[str]:
    return {str(root / name) for name in CONTENTS}


@pytest.mark.parametrize("budget", [1, 3, 200_000])
def test_list_tree_sees_everything(spark, tree, budget):
    rows = list_tree(spark, str(tree), tasks=3, entries_per_task=budget).collect()
    paths = [r.path for r in rows]
    assert len(paths) == len(set(paths))
    assert set(paths) == full(tree) | {str(tree / n) for n in ("link.txt", "broken", "pipe")}


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no directory to list"):
        list_tree(spark, str(tmp_path / "none"))


def test_empty_root(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).count() == 0
    assert scan_totals(scan(spark, str(tmp_path))).first() == (0, 0)


@pytest.mark.parametrize("options", [{}, {"pieces": "1"}, {"pieces": "500"}, {"planning_entries": "2"}])
def test_data_source_agrees_with_list_tree(spark, tree, options):
    register(spark)
    # Looking at a file through one reader must not change what the other one sees.
    columns = ["path", "size", "is_file", "is_symlink", "mtime", "error"]
    loaded = spark.read.format(FORMAT).options(**options).load(str(tree)).select(*columns)
    listed = list_tree(spark, str(tree)).select(*columns)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, listed.collect()))
    assert ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in spark.read.format(FORMAT).load(str(tree)).schema
    ) == LISTING


def test_planned_pieces_cover_the_tree_once(tree):
    for wanted in (1, 2, 3, 50):
        pieces = plan_subtrees(str(tree), wanted, 1000)
        folders = [d for d, _, _ in pieces]
        assert len(folders) == len(set(folders))
        deep = [d for d, whole, _ in pieces if whole]
        assert not any(a != b and a.startswith(b + "/") for a in folders for b in deep)


def test_scan(spark, tree):
    rows = {r.path: r for r in scan(spark, str(tree)).collect()}
    assert set(rows) == full(tree)
    row = rows[str(tree / "test.txt")]
    assert (row.name, row.ext, row.size, row.mime) == ("test.txt", ".txt", 11, "text/plain")
    assert (row.attrs, row.owner) == ("normal", "unknown")
    seen = os.stat(tree / "test.txt")
    as_utc = datetime.fromtimestamp(seen.st_mtime, timezone.utc).replace(tzinfo=None)
    assert row.modified == as_utc
    assert rows[str(tree / ".hidden")].ext == ""
    assert rows[str(tree / "sub/deep/A.TXT")].ext == ".txt"
    totals = scan_totals(scan(spark, str(tree))).first()
    assert tuple(totals) == (len(CONTENTS), sum(map(len, CONTENTS.values())))


def test_links_are_followed_if_asked(spark, tree):
    rows = {r.path: r for r in scan(spark, str(tree), follow_symlinks=True).collect()}
    assert set(rows) == full(tree) | {str(tree / "link.txt")}
    assert rows[str(tree / "link.txt")].size == 11


def test_rejected(spark, tree):
    listing = list_tree(spark, str(tree))
    got = {os.path.basename(r.path): r.reason for r in rejected_files(listing).collect()}
    assert got == {
        "link.txt": "symbolic link",
        "broken": "not a regular file",
        "pipe": "not a regular file",
    }


def test_listing_rows_with_errors_are_rejected(spark):
    listing = spark.createDataFrame(
        [("/x", None, False, False, None, None, None, None, None, "Permission denied")], LISTING
    )
    assert scan_inventory(listing).count() == 0
    assert rejected_files(listing).first().reason == "Permission denied"


def test_number_rows_is_dense_and_in_order(spark):
    rows = spark.range(1000).select(F.format_string("/p/%04d", "id").alias("path")).repartition(7)
    numbered = number_rows(rows, ["path"], "file_id", start=50)
    got = [(r.path, r.file_id) for r in numbered.orderBy("path").collect()]
    assert got == [(f"/p/{i:04d}", 50 + i) for i in range(1000)]


def test_append_is_repeatable_and_resumes(spark, tree, tmp_path):
    target = str(tmp_path / "inventory")
    added = append_inventory(scan(spark, str(tree)), target)
    assert added.count() == len(CONTENTS)
    assert append_inventory(scan(spark, str(tree)), target).count() == 0
    (tree / "later.txt").write_text("later")
    doubled = scan(spark, str(tree))
    again = append_inventory(doubled.unionByName(doubled), target).collect()
    assert [r.path for r in again] == [str(tree / "later.txt")]
    stored = read_inventory(spark, target)
    ids = [r.file_id for r in stored.collect()]
    assert stored.filter("ingested_at IS NULL").isEmpty()
    assert sorted(ids) == list(range(1, len(CONTENTS) + 2))
    assert {r.path for r in find_empty(stored).collect()} == {str(tree / "empty.txt")}


@pytest.mark.parametrize("settle", ["0", "60"])
def test_stream_takes_only_new_files(spark, tree, tmp_path, settle):
    target, checkpoint = str(tmp_path / "inventory"), str(tmp_path / "checkpoint")

    def run():
        ingest_new_files(
            spark, str(tree), target, checkpoint, settle_seconds=settle
        ).awaitTermination()
        return {r.path for r in read_inventory(spark, target).collect()}

    assert run() == full(tree)
    (tree / "sub" / "later.txt").write_text("later")
    assert run() == full(tree) | {str(tree / "sub" / "later.txt")}
    # A file written again is known already.
    (tree / "test.txt").write_text("changed")
    assert run() == full(tree) | {str(tree / "sub" / "later.txt")}
    # Moved in with their directory, files keep the times they had.
    outside = tmp_path / "outside" / "inner"
    outside.mkdir(parents=True)
    (outside / "moved.txt").write_text("moved")
    run()
    os.rename(tmp_path / "outside", tree / "sub" / "moved_in")
    assert str(tree / "sub" / "moved_in" / "inner" / "moved.txt") in run()
    paths = [r.path for r in read_inventory(spark, target).collect()]
    assert len(paths) == len(set(paths)) == len(CONTENTS) + 2


def test_what_a_run_could_not_read_is_looked_at_again(spark, tree, tmp_path):
    target, checkpoint = str(tmp_path / "inventory"), str(tmp_path / "checkpoint")

    def run():
        ingest_new_files(spark, str(tree), target, checkpoint, settle_seconds="0").awaitTermination()
        return {r.path for r in read_inventory(spark, target).collect()}

    assert run() == full(tree)
    # As if a directory had not been readable: its files are older than the last look.
    late = tmp_path / "late" / "deep"
    late.mkdir(parents=True)
    (late / "file.txt").write_text("late")
    gone = str(tmp_path / "gone")
    failed = spark.createDataFrame([(str(tmp_path / "late"),), (gone,)], "path string")
    failed.write.mode("append").parquet(unread_path(target))
    assert run() == full(tree) | {str(late / "file.txt")}
    assert run() == full(tree) | {str(late / "file.txt")}
    assert spark.read.parquet(unread_path(target)).filter(F.col("path").isin(gone, str(tmp_path / "late"))).isEmpty()


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "ledger")
    assert latest_snapshot(spark, base) is None
    first = write_snapshot(spark.range(3), base)
    second = write_snapshot(spark.read.parquet(first).selectExpr("id + 1 AS id"), base)
    assert latest_snapshot(spark, base) == second
    os.remove(f"{second}/_SUCCESS")
    assert latest_snapshot(spark, base) == first
    assert write_snapshot(spark.range(9), base) == second
    assert spark.read.parquet(latest_snapshot(spark, base)).count() == 9


@pytest.fixture
def inventory(spark, tree, tmp_path):
    append_inventory(scan(spark, str(tree)), str(tmp_path / "inv"))
    return read_inventory(spark, str(tmp_path / "inv"))


def test_hash_files(spark, tree, inventory):
    results = hash_files(inventory, tasks=3)
    merged = merge_results(inventory, results, "sha256")
    assert merged.columns == inventory.columns
    got = {r.path: r.sha256 for r in merged.collect()}
    assert got == {str(tree / n): hashlib.sha256(b).hexdigest() for n, b in CONTENTS.items()}
    assert got[str(tree / "test.txt")] == (
        "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    )


def test_merging_results_twice_keeps_one_row_per_file(spark, inventory):
    results = hash_files(inventory)
    failed = results.withColumn("sha256", F.lit(None).cast("string"))
    merged = merge_results(inventory, failed.unionByName(results).unionByName(results), "sha256")
    assert merged.count() == len(CONTENTS) and merged.filter("sha256 IS NULL").isEmpty()
    # No new value leaves the old one.
    kept = merge_results(merged, failed, "sha256")
    assert kept.filter("sha256 IS NULL").isEmpty()


def test_hash_reads_in_chunks(monkeypatch, tmp_path):
    monkeypatch.setattr(content, "CHUNK_BYTES", 8)
    (tmp_path / "f").write_bytes(b"x" * 100)
    assert content.sha256_of_file(str(tmp_path / "f")) == hashlib.sha256(b"x" * 100).hexdigest()


def test_failed_reads_become_outcomes(spark, tree, inventory):
    gone = str(tree / "test.txt")
    os.remove(gone)
    ledger = work.work_fan_out(inventory, datetime(2024, 1, 1))
    running = work.start_work(ledger, ledger.filter("kind = 'hash'"), "w1", datetime(2024, 1, 2))
    told = outcomes_of(running, "hash", hash_files(inventory))
    folded = work.record_outcomes(running, told, inventory, datetime(2024, 1, 3))
    rows = {(r.file_id, r.kind): r for r in folded.collect()}
    ids = {r.path: r.file_id for r in inventory.collect()}
    failed = rows[(ids[gone], "hash")]
    assert (failed.status, failed.attempts, failed.error) == ("retry", 1, f"nothing lies at {gone}")
    done = [r for r in rows.values() if r.status == "done"]
    assert len(done) == len(CONTENTS) - 1 and all(r.kind == "hash" for r in done)
    assert sum(r.status == "pending" for r in rows.values()) == len(CONTENTS)
    assert tuple(work.outcome_totals(running, folded).first()) == (len(CONTENTS) - 1, 1)


def test_object_store_hashing(spark, tree):
    for root in (str(tree), tree.as_uri()):
        rows = hash_objects(spark, root, tasks=3).collect()
        got = {os.path.relpath(r.path, tree): (r.size, r.sha256, r.error) for r in rows}
        assert len(got) == len(rows)
        assert got.pop("pipe")[2]
        assert got.pop("link.txt")[1] == hashlib.sha256(CONTENTS["test.txt"]).hexdigest()
        assert got == {n: (len(b), hashlib.sha256(b).hexdigest(), None) for n, b in CONTENTS.items()}


def test_object_store_rows_for_what_cannot_be_read(spark, tmp_path):
    (tmp_path / ".h").mkdir()
    for name, body in (("a.txt", "a"), ("empty.txt", ""), ("_u.txt", "u"), (".h/b.txt", "b")):
        (tmp_path / name).write_text(body)
    os.mkfifo(tmp_path / "pipe")
    rows = {os.path.relpath(r.path, tmp_path): r for r in hash_objects(spark, str(tmp_path)).collect()}
    assert {n for n, r in rows.items() if r.sha256} == {"a.txt", "empty.txt", "_u.txt", ".h/b.txt"}
    assert rows["pipe"].error
    missing = hash_objects(spark, str(tmp_path / "none")).collect()
    assert len(missing) == 1 and missing[0].error


def test_files_are_dealt_by_size(spark):
    sizes = [10**6, 10**6] + [10] * 40
    files = spark.createDataFrame([(i, f"/{i}", s) for i, s in enumerate(sizes)], "file_id bigint, path string, size bigint")
    spread = content.spread_by_size(files, "file_id", 4).withColumn("task", F.spark_partition_id())
    tasks = {}
    for row in spread.collect():
        tasks.setdefault(row.task, []).append(row.size)
    assert sorted(len(x) for x in tasks.values()) == [10, 10, 11, 11]
    assert max(x.count(10**6) for x in tasks.values()) == 1


def test_extract_metadata(spark, tree, inventory):
    def pdf(raw: bytes) -> dict:
        return {"paginas": 1, "versao": raw[:8].decode()}

    types = ["txt", "csv", "json", "pdf", "jpg", "log"]
    results = extract_metadata(inventory, types, size_cap=20, extractors={"pdf": pdf}, tasks=3)
    got = {
        os.path.relpath(r.path, tree): json.loads(r.metadata)
        for r in inventory.drop("metadata").join(results, "file_id").collect()
    }
    assert got == {
        "test.txt": {"linhas": 1, "caracteres": 11, "vazio": False},
        "sub/deep/copy.txt": {"linhas": 1, "caracteres": 11, "vazio": False},
        "empty.txt": {"linhas": 1, "caracteres": 0, "vazio": True},
        "big.bin": {"skipped": "file too large"},
        ".hidden": {"skipped": "extension  not in analysis list"},
        "_underscore.csv": {"linhas": 3, "caracteres": 8, "vazio": False},
        "sub/with space+plus%41.json": {"linhas": 1, "caracteres": 8, "vazio": False},
        "sub/deep/er/file3.pdf": {"skipped": "file too large"},
        "sub/deep/A.TXT": {"linhas": 2, "caracteres": 6, "vazio": False},
        "flat/é.log": {"skipped": "no analyzer for .log"},
    }
    wide = extract_metadata(inventory, types, extractors={"pdf": pdf})
    pdf_id = inventory.filter("ext = '.pdf'").first().file_id
    assert json.loads(wide.filter(F.col("file_id") == pdf_id).first().metadata) == {
        "paginas": 1, "versao": "%PDF-1.4",
    }


def test_extractors_that_fail_or_are_missing(spark, tree, inventory):
    def broken(raw: bytes) -> dict:
        raise ValueError("bad header")

    one = inventory.filter("ext = '.pdf'")
    failed = extract_metadata(one, extractors={"pdf": broken}).first()
    assert json.loads(failed.metadata) == {"erro": "bad header"} and failed.error is None
    missing = extract_metadata(one).first()
    assert json.loads(missing.metadata) == {"erro": "no extractor installed for pdf"}


def test_live_size_counts_for_the_cap(spark, tree, inventory):
    path = str(tree / "test.txt")
    with open(path, "ab") as stream:
        stream.write(b"y" * 100)
    one = inventory.filter(F.col("path") == path)
    row = extract_metadata(one, size_cap=50).first()
    assert json.loads(row.metadata) == {"skipped": "file too large"}
    os.remove(path)
    row = extract_metadata(one, size_cap=50).first()
    assert row.metadata is None and row.error == f"nothing lies at {path}"


def test_enrich_files_with_own_work(spark, tree, inventory):
    def first_byte(path: str) -> dict:
        with open(path, "rb") as stream:
            return {"first": stream.read()[0], "length": os.stat(path).st_size}

    got = {
        r.file_id: r for r in content.enrich_files(inventory, first_byte, "first int, length bigint").collect()
    }
    for row in inventory.collect():
        body = CONTENTS[os.path.relpath(row.path, tree)]
        result = got[row.file_id]
        if body:
            assert (result.first, result.length, result.error) == (body[0], len(body), None)
        else:
            assert result.first is None and "out of range" in result.error


def test_results_of_two_jobs_are_merged_by_column(spark):
    inventory = spark.createDataFrame([(1, None, None), (2, "old", None)], "file_id bigint, sha256 string, metadata string")
    results = spark.createDataFrame(
        [(1, "aa", None), (1, None, "{}"), (2, None, "{}")], "file_id bigint, sha256 string, metadata string"
    )
    merged = merge_results(inventory, results, "sha256", "metadata")
    assert sorted(map(tuple, merged.collect())) == [(1, "aa", "{}"), (2, "old", "{}")]


def test_known_paths_go_before_repeats_are_looked_for(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id AS string) AS path", "id AS size").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = resume_new_files(files, files.filter("size < 990").select("path"))
        assert new.count() == 10
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert final.index("Aggregate") < final.index("LeftAnti")
    assert final.count("Exchange hashpartitioning") == 2


def test_files_left(spark, inventory):
    done = hash_files(inventory.filter("size > 0")).filter("error IS NULL")
    assert {r.name for r in files_left(inventory, done).collect()} == {"empty.txt"}


def test_resume_without_regard_to_case(spark):
    files = spark.createDataFrame(
        [("/A/x", 1), ("/a/X", 2), ("/b", 3), ("/C", 4), ("/C", 4)], "path string, size bigint"
    )
    known = spark.createDataFrame([("/B",), ("/c2",)], "path string")
    exact = resume_new_files(files, known)
    assert sorted(map(tuple, exact.collect())) == [("/A/x", 1), ("/C", 4), ("/a/X", 2), ("/b", 3)]
    loose = resume_new_files(files, known, ignore_case=True)
    assert sorted(map(tuple, loose.collect())) == [("/A/x", 1), ("/C", 4)]


def test_checkpoint_folder_comes_from_the_session(spark):
    cut = cut_lineage(spark.range(3))
    assert sorted(r.id for r in cut.collect()) == [0, 1, 2]
    folder = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert folder and (configured is None or configured in folder)


def test_filters_and_columns_reach_the_scan(spark, inventory):
    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString()

    empty = scans(find_empty(inventory))
    assert "PushedFilters: [IsNotNull(size), EqualTo(size,0)]" in empty
    assert "metadata" not in empty and "sha256" not in empty
    large = scans(find_large(inventory))
    assert "GreaterThanOrEqual(size,104857600)" in large
    old = scans(find_old(inventory, as_of=datetime(2026, 1, 1)))
    assert "LessThan(accessed,2025-01-01T00:00)" in old
