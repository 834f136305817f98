"""Duplicate reports against brute force, with groups large enough to be split."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileledger.operators import duplicates
from fileledger.operators.heavy_keys import join_groups
from fileledger.operators.ordering import number_in_groups

SCHEMA = (
    "file_id bigint, path string, name string, size bigint, created timestamp_ntz, "
    "modified timestamp_ntz, sha256 string"
)
START = datetime(2024, 1, 1)


def make_files(count: int, seed: int = 7) -> list[tuple]:
    """A third of all files share one hash; the rest fall into small groups; some are unhashed."""
    pick = random.Random(seed)
    files = []
    for i in range(count):
        sha = "hot" if i % 3 == 0 else f"h{pick.randrange(count // 4)}"
        sha = None if i % 17 == 0 else sha
        created = None if pick.random() < 0.05 else START + timedelta(days=pick.randrange(20))
        # Sizes may differ inside a group: the hash may be of later content than the size.
        size = 0 if sha == "hot" else pick.choice([10, 10, 10, 2000])
        files.append((i, f"/d/{i}.txt", f"{i}.txt", size, created, START, sha))
    pick.shuffle(files)
    return files


def age(file: tuple) -> tuple:
    return (file[4] is not None, file[4] or START, file[0])


def brute_groups(files: list[tuple], min_size: int = 0) -> dict[str, dict]:
    by_hash = defaultdict(list)
    for file in files:
        if file[6] is not None:
            by_hash[file[6]].append(file)
    groups = {}
    for sha, members in by_hash.items():
        counted = [f for f in members if f[3] >= min_size]
        if len(counted) > 1:
            members.sort(key=age)
            total = sum(f[3] for f in counted)
            groups[sha] = {
                "count": len(counted),
                "total": total,
                "wasted": total - members[0][3],
                "members": [f[0] for f in members],
                "keeper": members[0],
            }
    return groups


@pytest.fixture(scope="module")
def files():
    return make_files(900)


@pytest.fixture(scope="module")
def inventory(spark, files):
    return spark.createDataFrame(files, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("min_size", [0, 1, 10, 2000])
def test_groups(inventory, files, min_size):
    expected = brute_groups(files, min_size)
    rows = duplicates.duplicate_groups(inventory, min_size).collect()
    assert {
        r.sha256: (r["count"], r.total_size, r.wasted_size, r.keeper_id, r.suggestion) for r in rows
    } == {
        sha: (g["count"], g["total"], g["wasted"], g["keeper"][0], f"Keep oldest: {g['keeper'][1]}")
        for sha, g in expected.items()
    }
    order = [(-r.total_size, r.sha256) for r in rows]
    assert order == sorted(order)


@pytest.mark.parametrize("slice_rows", [1, 7, 50, 1_000_000])
@pytest.mark.parametrize("min_size", [0, 10])
def test_members(inventory, files, min_size, slice_rows):
    expected = brute_groups(files, min_size)
    rows = duplicates.duplicate_members(inventory, min_size, slice_rows).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.sha256].append(r.file_id)
    assert got == {sha: g["members"] for sha, g in expected.items()}
    assert sum(r.is_keeper for r in rows) == len(expected)
    removable = duplicates.removable_files(inventory, min_size, slice_rows).collect()
    assert {r.file_id for r in removable} == {r.file_id for r in rows if not r.is_keeper}
    assert len(removable) == len(rows) - len(expected)


@pytest.mark.parametrize("page_files", [4, 10_000])
def test_nested_report(inventory, files, page_files):
    expected = brute_groups(files)
    rows = duplicates.find_duplicates(inventory, page_files=page_files, slice_rows=20).collect()
    ids = defaultdict(list)
    for r in rows:
        assert r.page * page_files == len(ids[r.sha256]) and len(r.files) <= page_files
        ids[r.sha256] += [f.file_id for f in r.files]
    assert ids == {sha: g["members"] for sha, g in expected.items()}
    assert len(rows) == sum(-(-len(i) // page_files) for i in ids.values())
    # Sums over the report are those over the groups.
    groups = duplicates.duplicate_groups(inventory).collect()
    for column in ("count", "total_size", "wasted_size"):
        assert sum(r[column] or 0 for r in rows) == sum(g[column] for g in groups)


def test_every_heavy_key_is_split(spark):
    rows = spark.range(0, 1001 * 6, numPartitions=8).selectExpr("id", "id % 1001 AS key")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    met = join_groups(rows, groups, "key", "n", "id", slice_rows=2)
    slices = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in slices
    assert met.count() == 1001 * 6 and met.select("id").distinct().count() == 1001 * 6


def test_groups_are_summed_up_without_sorting(spark, tmp_path):
    files = [(i, f"/{i}", str(i), 5, START, START, f"h{i // 2}") for i in range(20)]
    spark.createDataFrame(files, SCHEMA).write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    groups = lambda files: duplicates._groups(files, 0)  # noqa: E731  the report looks at them written down
    for report in (groups, duplicates.duplicate_members, duplicates.removable_files):
        plan = report(stored)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_ids_below_zero_and_early_times_are_kept_apart(spark):
    early = datetime(1900, 1, 1)
    files = [(-5, "/a", "a", 1, early, START, "x"), (7, "/b", "b", 1, early, START, "x"), (-9, "/c", "c", 1, START, START, "x"),
             (2**62, "/d", "d", 1, None, START, "y"), (-(2**62), "/e", "e", 1, None, START, "y")]
    rows = duplicates.duplicate_groups(spark.createDataFrame(files, SCHEMA)).collect()
    assert {r.sha256: (r.keeper_id, r.keeper_path) for r in rows} == {"x": (-5, "/a"), "y": (-(2**62), "/e")}


def test_all_empty_group_wastes_nothing(spark):
    files = [(i, f"/{i}", str(i), 0, START, START, "e") for i in range(3)]
    row = duplicates.duplicate_groups(spark.createDataFrame(files, SCHEMA)).first()
    assert (row["count"], row.total_size, row.wasted_size) == (3, 0, 0)


def test_no_duplicates(spark):
    alone = spark.createDataFrame([(1, "/a", "a", 5, None, None, "x")], SCHEMA)
    assert duplicates.duplicate_groups(alone).count() == 0
    assert duplicates.duplicate_members(alone).count() == 0
    assert duplicates.find_duplicates(alone).count() == 0


@pytest.mark.parametrize("slice_rows", [10, 1_000_000])
def test_numbers_in_groups_like_row_number(spark, inventory, slice_rows):
    grouped = inventory.filter("sha256 IS NOT NULL").select("sha256", "created", "file_id")
    numbered = number_in_groups(
        grouped, "sha256", ["created", "file_id"], "number", "file_id", slice_rows
    )
    window = Window.partitionBy("sha256").orderBy(F.asc_nulls_first("created"), "file_id")
    expected = grouped.withColumn("number", F.row_number().over(window).cast("bigint"))
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, expected.collect()))


@pytest.mark.parametrize("slice_rows", [3, 1_000_000])
def test_files_sharing_a_size(inventory, files, slice_rows):
    sizes = defaultdict(int)
    for f in files:
        sizes[f[3]] += 1
    got = duplicates.files_sharing_a_size(inventory, slice_rows).collect()
    assert sorted(r.file_id for r in got) == sorted(f[0] for f in files if sizes[f[3]] > 1)
    # Hashing only these gives the same report.
    few = duplicates.files_sharing_a_size(inventory.filter("size <> 10"), slice_rows)
    assert few.columns == inventory.columns


def test_rows_of_a_heavy_key_are_spread(spark):
    rows = spark.range(2000).select(F.col("id").alias("row"), F.lit("k").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = join_groups(rows, groups, "key", "n", "row", slice_rows=100)
        sizes = [
            r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(sizes) == 2000
    assert len(sizes) > 3 and max(sizes) < 1200


def test_rows_without_key_stay_and_are_spread(spark):
    rows = spark.range(500).select(F.col("id").alias("row"), F.lit(None).cast("string").alias("key"))
    groups = spark.createDataFrame([("k", 4)], "key string, n bigint")
    joined = join_groups(rows, groups, "key", "n", "row", how="left", slice_rows=100)
    assert joined.count() == 500


def _plan_text(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_member_plan_scans_the_inventory_twice_only(spark, tmp_path, files):
    spark.createDataFrame(files, SCHEMA).write.parquet(str(tmp_path / "inv"))
    stored = spark.read.parquet(str(tmp_path / "inv"))
    final = _plan_text(duplicates.duplicate_members(stored)).split("Initial Plan")[0]
    # Once for the groups, whose shuffle also tells the heavy keys, and once for the members.
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1
