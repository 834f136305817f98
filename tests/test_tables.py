"""Inventories in buckets, and the filter of ids before a join."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fileledger.operators import duplicates, scan
from fileledger.operators.membership import among
from fileledger.schema import INVENTORY
from fileledger.sources.tables import in_inventory_layout, open_bucketed, write_bucketed


def exchanges(frame) -> int:
    """Shuffles by a key in the plan that ran, or is going to run."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall("Exchange hashpartitioning", plan))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def files(spark):
    made = spark.range(400).select(
        F.col("id").alias("file_id"), F.concat(F.lit("/a/"), F.col("id") % 7, F.lit("/"), "id").alias("path"),
        F.lit("x").alias("name"), (F.col("id") % 5).alias("size"),
    )
    return in_inventory_layout(made)


def test_known_paths_in_buckets_stay_where_they_lie(spark, files, tmp_path, no_broadcast):
    name = write_bucketed(files.filter("file_id < 300"), str(tmp_path / "known"), 8)
    known = spark.table(name)
    new = scan.resume_new_files(files.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(1)))), known)
    assert {r.file_id for r in new.collect()} == set(range(300, 400)) and new.count() == 100
    # One exchange, of the listing; the anti-join and the reduction to a row a path share it.
    assert exchanges(new) == 1
    present = files.filter("file_id % 3 = 0").select("path", F.lit(True).alias("is_file"))
    left = scan.refresh_inventory(known, present)
    assert {r.file_id for r in left.collect()} == set(range(0, 300, 3))
    assert exchanges(left) == 1


def test_buckets_grow_and_are_found_again(spark, files, tmp_path, no_broadcast):
    folder = str(tmp_path / "known")
    name = write_bucketed(files.filter("file_id < 100"), folder, 8)
    write_bucketed(files.filter("file_id between 100 and 199"), folder, 8, name, mode="append")
    for known in (spark.table(name), open_bucketed(spark, folder, 8, INVENTORY)):
        assert known.columns == files.columns and known.count() == 200
        new = scan.resume_new_files(files, known)
        assert {r.file_id for r in new.collect()} == set(range(200, 400))
        assert exchanges(new) == 1


def test_no_id_is_lost_and_few_others_stay(spark):
    rows = spark.range(0, 100_000, 1, 4).select(F.when(F.col("id") % 10 != 0, F.col("id") - 50_000).alias("id"), F.lit(1).alias("x"))
    ids = spark.range(-50_000, 50_000, 37).select(F.col("id").alias("wanted"))
    kept = among(rows, "id", ids)
    want = rows.join(ids, rows["id"] == ids["wanted"], "left_semi").select("id")
    assert want.exceptAll(kept.select("id")).count() == 0
    assert kept.columns == rows.columns and kept.filter("id is null").count() == 0
    assert kept.count() < want.count() + 0.06 * 100_000
    assert among(rows, "id", ids, most_bits=1024) is rows
    few = among(rows, "id", ids.limit(30).unionByName(ids.limit(1).select(F.lit(None).cast("bigint").alias("wanted"))))
    assert few.count() == want.join(ids.limit(30), F.col("id") == F.col("wanted")).count()
    for named in (0, 1000):
        assert among(rows, "id", ids.limit(0), named).count() == 0
        assert -50_000 + 37 in {r.id for r in among(rows, "id", ids.filter("wanted = -50000 + 37"), named).collect()}


def test_only_keepers_are_moved_a_second_time(spark, tmp_path, no_broadcast):
    made = spark.range(20_000).select(
        F.col("id").alias("file_id"), F.concat(F.lit("/"), "id").alias("path"), F.lit("n").alias("name"),
        F.lit(3).cast("bigint").alias("size"), F.sha2((F.col("id") % 18_000).cast("string").cast("binary"), 256).alias("sha256"),
    )
    path = str(tmp_path / "inventory")
    in_inventory_layout(made).write.parquet(path)
    groups = duplicates.duplicate_groups(spark.read.parquet(path))
    rows = groups.collect()
    assert len(rows) == 2000 and all(r.keeper_path == f"/{r.keeper_id}" and r.keeper_id < 2000 for r in rows)
    # The inventory is scanned once more, behind the filter, and only what passes is shuffled.
    plan = duplicates.duplicate_groups(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    below = plan[: plan.index("FileScan parquet")]
    moved, kept = below.rindex("Exchange hashpartitioning(keeper_id"), below.rindex("Filter (")
    assert moved < kept and "getbit" in below[kept:]


def test_only_ranges_with_results_are_rewritten(spark, files, tmp_path):
    from fileledger.sources.tables import read_ranges, update_ranges, write_ranges

    folder = str(tmp_path / "ranges")
    write_ranges(files, folder, 100)

    def stored():
        return {p.relative_to(folder).as_posix() for p in (tmp_path / "ranges").glob("id_range=*/part-*")}

    before = stored()
    assert {p.split("/")[0] for p in before} == {f"id_range={k}" for k in range(4)}
    results = spark.createDataFrame([(5, "five"), (7, None), (301, "late"), (5, None), (9999, "unknown"), (None, "x")], "file_id bigint, sha256 string")
    for _ in range(2):  # a job broken off and begun again
        assert update_ranges(spark, folder, results, "sha256", range_ids=100) == [0, 3, 99]
        found = read_ranges(spark, folder)
        assert {r.file_id: r.sha256 for r in found.filter("sha256 is not null").collect()} == {5: "five", 301: "late"}
        assert found.drop("id_range", "sha256").exceptAll(files.drop("sha256")).count() == 0 and found.count() == 400
        kept = {p for p in before if p.startswith(("id_range=1/", "id_range=2/"))}
        assert kept <= stored() and not (before - kept) & stored()
    assert update_ranges(spark, folder, results.limit(0), "sha256", range_ids=100) == []
