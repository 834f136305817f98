"""Reports on disk, and quarantine, restore and removal plans."""

from __future__ import annotations

import csv
import json
from datetime import datetime

import pytest

from fileledger import (
    analyze,
    clean_plan,
    clean_preview,
    clean_totals,
    find_duplicates,
    find_empty,
    find_large,
    find_old,
    find_temp,
    list_quarantine,
    quarantine_plan,
    read_report,
    report_items,
    restore_plan,
    write_report,
)
from fileledger.plans.quarantine import action_totals, manifest_of
from fileledger.sources.directory import list_tree
from fileledger.sources.sidecars import read_sidecars
from fileledger.sources.tables import append_manifest, read_manifest

AT = datetime(2026, 1, 1)
SCHEMA = (
    "file_id bigint, path string, name string, ext string, size bigint, created timestamp_ntz, "
    "modified timestamp_ntz, accessed timestamp_ntz, sha256 string, metadata string"
)
ROWS = [
    (1, "/a/x.txt", "x.txt", ".txt", 104857600, datetime(2020, 1, 1), AT, datetime(2024, 12, 31, 23), "h1", '{"titulo": "Contrato"}'),
    (2, "/b/x.txt", "x.txt", ".txt", 104857600, datetime(2021, 1, 1), AT, datetime(2025, 1, 1), "h1", "{}"),
    (3, "/c/x.txt", "x.txt", ".txt", 104857600, datetime(2022, 1, 1, 0, 0, 0, 5), None, None, "h1", None),
    (4, "/d/y.txt~", "y.txt~", ".txt~", 10, None, AT, datetime(2020, 6, 1, 12), "h2", None),
    (5, "/e/z.tmp", "z.tmp", ".tmp", 10, datetime(2020, 1, 1), AT, AT, "h2", None),
    (6, "/f/empty", "empty", "", 0, datetime(2020, 1, 1), AT, AT, "h3", None),
    (7, "/g/x~", "x~", "", 5, datetime(2020, 1, 1), AT, AT, None, '{"contrato": 1}'),
]


@pytest.fixture
def inventory(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return [r.file_id for r in df.collect()]


def test_reports(inventory):
    assert ids(find_large(inventory)) == [1, 2, 3]
    assert find_large(inventory).first().size_mb == 100.0
    assert ids(find_old(inventory, as_of=AT)) == [4, 1]
    assert [r.days_idle for r in find_old(inventory, as_of=AT).collect()] == [2039, 365]
    assert ids(find_old(inventory, days=-1, as_of=AT))== [4, 1, 2, 5, 6, 7]
    assert ids(find_temp(inventory)) == [4, 5]
    assert ids(find_empty(inventory)) == [6]


def test_analyze_by_name(inventory):
    assert [r.sha256 for r in analyze(inventory, "duplicates").collect()] == ["h1", "h2"]
    assert [r.sha256 for r in analyze(inventory, "duplicates", min_size=100).collect()] == ["h1"]
    assert ids(analyze(inventory, "large")) == [1, 2, 3]
    assert ids(analyze(inventory, "large", limit="10B")) == [1, 2, 3, 4, 5]
    assert ids(analyze(inventory, "old", days=365, as_of=AT)) == [4, 1]
    assert ids(analyze(inventory, "temp")) == [4, 5]
    assert ids(analyze(inventory, "empty")) == [6]
    assert ids(analyze(inventory, "search", keyword="ontrat")) == [1]
    with pytest.raises(ValueError, match="needs a keyword"):
        analyze(inventory, "search")
    with pytest.raises(ValueError, match="no report is called"):
        analyze(inventory, "newest")


def lines(folder):
    parts = sorted(folder.glob("part-*"))
    return [line for part in parts for line in part.read_text(encoding="utf-8").splitlines()]


def test_json_report_round_trip(spark, inventory, tmp_path):
    path = write_report(find_duplicates(inventory), str(tmp_path / "deep" / "dup"))
    first = json.loads(lines(tmp_path / "deep" / "dup")[0])
    assert first["sha256"] == "h1" and first["wasted_size"] == 209715200
    assert [f["created"] for f in first["files"]] == [
        "2020-01-01T00:00:00", "2021-01-01T00:00:00", "2022-01-01T00:00:00.000005",
    ]
    assert first["files"][2]["modified"] is None
    items = report_items(read_report(spark, path))
    assert sorted(map(tuple, items.collect())) == [
        (2, "/b/x.txt", 104857600), (3, "/c/x.txt", 104857600), (5, "/e/z.tmp", 10),
    ]


def test_flat_report_round_trip(spark, inventory, tmp_path):
    path = write_report(find_temp(inventory), str(tmp_path / "temp"))
    assert sorted(map(tuple, report_items(read_report(spark, path)).collect())) == [
        (4, "/d/y.txt~", 10), (5, "/e/z.tmp", 10),
    ]


def test_csv_report(inventory, tmp_path):
    write_report(find_duplicates(inventory), str(tmp_path / "dup"), "csv")
    parts = sorted((tmp_path / "dup").glob("part-*"))
    rows = [row for part in parts for row in csv.DictReader(part.open(newline=""))]
    assert [r["sha256"] for r in rows] == ["h1", "h2"]
    assert [f["file_id"] for f in json.loads(rows[0]["files"])] == [1, 2, 3]
    assert rows[1]["suggestion"] == "Keep oldest: /d/y.txt~"
    with pytest.raises(ValueError, match="not as xml"):
        write_report(find_empty(inventory), str(tmp_path / "x"), "xml")


def test_array_reports_of_the_earlier_tool(spark, tmp_path):
    flat = [{"id": 1, "caminho": "/a", "tamanho": 3}, {"other": True}]
    nested = [{"hash": "h", "count": 2, "files": [{"id": 7, "caminho": "/k"}, {"id": 8, "caminho": "/r", "tamanho": 4}]}]
    (tmp_path / "flat.json").write_text(json.dumps(flat, indent=2))
    (tmp_path / "nested.json").write_text(json.dumps(nested, indent=2))
    read = lambda name: report_items(read_report(spark, str(tmp_path / name), single_array=True))
    assert [tuple(r) for r in read("flat.json").collect()] == [(1, "/a", 3)]
    assert [tuple(r) for r in read("nested.json").collect()] == [(8, "/r", 4)]


def listing(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize("slice_rows", [1, 1_000_000])
def test_quarantine_plan(spark, inventory, slice_rows):
    asked = [(2,), (3,), (3,), (5,), (77,), (78,), (None,), (4,)]
    items = spark.createDataFrame(asked, "file_id bigint")
    present = listing(spark, ["/b/x.txt", "/c/x.txt", "/e/z.tmp", "/e/z.tmp"])
    plan = quarantine_plan(items, inventory, present, "/q/", AT, slice_rows)
    assert {r.file_id: tuple(r)[1:] for r in plan.collect()} == {
        2: ("/b/x.txt", "/q/20260101_000000_same/2/x.txt", "moved", None),
        3: ("/c/x.txt", "/q/20260101_000000_same/3/x.txt", "moved", None),
        5: ("/e/z.tmp", "/q/20260101_000000/z.tmp", "moved", None),
        4: ("/d/y.txt~", None, "skipped", "file not found"),
        77: (None, None, "skipped", "not found"),
        78: (None, None, "skipped", "not found"),
    }
    assert plan.count() == 6
    assert {r.action: r.files for r in action_totals(plan).collect()} == {"moved": 3, "skipped": 3}


def test_quarantine_spreads_one_name_held_by_most(spark):
    files = [(i, f"/{i}/index.html" if i % 3 else f"/{i}/page{i}.html", "") for i in range(600)]
    inventory = spark.createDataFrame(files, "file_id bigint, path string, name string")
    plan = quarantine_plan(
        inventory.select("file_id"), inventory, inventory.select("path"), "/q", AT, slice_rows=50
    ).collect()
    targets = [r.destination for r in plan]
    assert len(plan) == len(set(targets)) == 600
    assert all(t.endswith(f"_same/{r.file_id}/index.html") for r, t in zip(plan, targets) if r.file_id % 3)
    assert all(t.endswith(f"page{r.file_id}.html") for r, t in zip(plan, targets) if not r.file_id % 3)


def test_quarantine_destinations_differ(spark):
    files = [(1, "/a/x"), (2, "/b/x"), (3, "/c/x_1"), (4, "/d/x_2"), (5, "/e/1"), (6, "/f/x_1")]
    inventory = spark.createDataFrame(files, "file_id bigint, path string")
    plan = quarantine_plan(inventory.select("file_id"), inventory, inventory.select("path"), "/q", AT).collect()
    targets = [r.destination for r in plan]
    assert len(set(targets)) == 6
    # Nor is a file's place a folder of another's.
    assert not any(a != b and b.startswith(a + "/") for a in targets for b in targets)


def test_manifest_and_quarantine_list(spark, inventory, tmp_path):
    items = spark.createDataFrame([(2,), (5,)], "file_id bigint")
    plan = quarantine_plan(items, inventory, inventory.select("path"), "/q", AT)
    append_manifest(manifest_of(plan, AT), str(tmp_path / "manifest"))
    manifest = read_manifest(spark, str(tmp_path / "manifest"))
    there = listing(spark, ["/q/20260101_000000/x.txt"])
    got = {r.file_id: (r.original_path, r.quarantine_date, r.exists) for r in list_quarantine(manifest, there).collect()}
    assert got == {2: ("/b/x.txt", AT, True), 5: ("/e/z.tmp", AT, False)}


@pytest.mark.parametrize("slice_rows", [1, 1_000_000])
def test_restore_plan(spark, slice_rows):
    manifest = spark.createDataFrame(
        [("/o/a", "/q/1/a", AT, 1), ("/o/b", "/q/1/b", AT, 2), ("/o/c", "/q/1/c", AT, 3), ("/o/c", "/q/2/c", AT, 4), ("/o/old", "/q/1/a", datetime(2025, 1, 1), 9)],
        "original_path string, quarantine_path string, quarantine_date timestamp_ntz, file_id bigint",
    )
    asked = spark.createDataFrame(
        [("/q/1/a",), ("/q/1/b",), ("/q/1/c",), ("/q/2/c",), ("/q/9/z",), ("/q/9/y",), ("/q/1/a",)],
        "quarantine_path string",
    )
    plan = restore_plan(asked, manifest, listing(spark, ["/o/b"]), slice_rows)
    assert {r.quarantine_path: tuple(r)[1:] for r in plan.collect()} == {
        "/q/1/a": ("/o/a", "restored", None),
        "/q/1/b": ("/o/b", "refused", "Original path already exists"),
        "/q/1/c": ("/o/c", "restored", None),
        "/q/2/c": ("/o/c", "refused", "Original path already exists"),
        "/q/9/z": (None, "refused", "Quarantine metadata not found"),
        "/q/9/y": (None, "refused", "Quarantine metadata not found"),
    }
    assert plan.count() == 6


def test_sidecars(spark, tmp_path):
    root = tmp_path / "q" / "20260101_000000"
    root.mkdir(parents=True)
    record = {"original_path": "/o/a b.txt", "quarantine_date": "2026-01-01T10:00:00.5", "file_id": 4}
    for name in ("a b.txt", ".hidden"):
        (root / f"{name}.quarantine.json").write_text(json.dumps(record))
    (root / "a b.txt").write_text("x")
    (root / "bad.quarantine.json").write_text("{not json")
    (root / "other.quarantine.json").write_text("[]")
    (root / "binary.quarantine.json").write_bytes(b"\xff\xfe")
    (root / "unrelated.json").write_text("{}")
    tree = list_tree(spark, str(tmp_path / "q"))
    manifest, broken = read_sidecars(tree)
    got = {r.quarantine_path: tuple(r) for r in list_quarantine(manifest, tree).collect()}
    at = datetime(2026, 1, 1, 10, 0, 0, 500000)
    assert got == {
        str(root / "a b.txt"): ("/o/a b.txt", str(root / "a b.txt"), at, 4, True),
        str(root / ".hidden"): ("/o/a b.txt", str(root / ".hidden"), at, 4, False),
    }
    assert {r.path.rsplit("/", 1)[1].split(".")[0] for r in broken.collect()} == {
        "bad", "other", "binary",
    }


@pytest.mark.parametrize("count", [0, 3, 10, 25])
def test_clean(spark, count):
    rows = [(i, f"/p/{i:03d}", 2) for i in range(count)] + [(900, None, 5)]
    plan = clean_plan(spark.createDataFrame(rows, "file_id bigint, path string, size bigint"))
    assert tuple(clean_totals(plan).first()) == (count, 2 * count)
    shown = [r.text for r in clean_preview(plan).collect()]
    assert shown == [f"  - /p/{i:03d}" for i in range(min(count, 10))] + (
        [f"  ... and {count - 10} more"] if count > 10 else []
    )
