"""Ledger steps on small frames."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fileledger.operators import ledger as work
from fileledger.schema import LEDGER, STATUSES

AT = datetime(2024, 5, 1, 12)


def make(spark, rows):
    """Ledger rows from (work_id, file_id, kind, status, attempts)."""
    full = [
        (w, f, kind, status, 0, attempts, 3, None, None, None, None, None)
        for w, f, kind, status, attempts in rows
    ]
    return spark.createDataFrame(full, LEDGER)


ROWS = [
    (1, 10, "hash", "pending", 0),
    (2, 10, "analyze", "queued", 0),
    (3, 11, "hash", "running", 2),
    (4, 11, "analyze", "running", 0),
    (5, 12, "hash", "retry", 1),
    (6, 12, "analyze", "retry", 3),
    (7, 99, "hash", "running", 0),
    (8, 13, "hash", "done", 1),
    (9, 13, "analyze", "error", 3),
    (10, 99, "hash", "queued", 0),
]


@pytest.fixture
def ledger(spark):
    return make(spark, ROWS)


@pytest.fixture
def inventory(spark):
    sizes = [(10, 100), (11, 5000), (12, 20_000_000), (13, 0)]
    return spark.createDataFrame(sizes, "file_id bigint, size bigint")


def by_id(df):
    return {r.work_id: r for r in df.collect()}


def test_fan_out(spark, inventory):
    rows = by_id(work.work_fan_out(inventory, AT, max_attempts=5))
    assert sorted(rows) == sorted(2 * f + k for f in (10, 11, 12, 13) for k in (0, 1))
    row = rows[21]
    assert (row.file_id, row.kind, row.status, row.priority, row.attempts, row.max_attempts) == (
        10, "analyze", "pending", 0, 0, 5,
    )
    assert row.created_at == AT and row.started_at is None
    layout = spark.createDataFrame([], LEDGER).schema
    made = work.work_fan_out(inventory, AT).schema
    assert [(f.name, f.dataType) for f in made] == [(f.name, f.dataType) for f in layout]


def test_fan_out_without_analysis(inventory):
    rows = by_id(work.work_fan_out(inventory, AT, analyze=False))
    assert sorted(rows) == [20, 22, 24, 26] and {r.kind for r in rows.values()} == {"hash"}


def test_missing_work_adds_nothing_twice(ledger, inventory):
    assert work.missing_work(inventory, ledger, AT).count() == 0
    part = ledger.filter("file_id <> 13")
    first = work.missing_work(inventory, part, AT)
    assert {r.file_id for r in first.collect()} == {13}
    assert work.missing_work(inventory, part.unionByName(first), AT).count() == 0


@pytest.mark.parametrize("count_attempt, attempts", [(True, 2), (False, 1)])
def test_promote(ledger, count_attempt, attempts):
    moved = work.promote(ledger, count_attempt)
    rows = by_id(moved)
    assert {w for w, r in rows.items() if r.changed} == {1, 5}
    assert rows[1].status == rows[5].status == "queued"
    assert rows[5].attempts == attempts and rows[1].attempts == 0
    assert rows[6].status == "retry" and rows[6].attempts == 3
    assert work.rows_changed(moved).first().changed == 2


def test_prioritize(ledger, inventory):
    rows = by_id(work.prioritize(ledger, inventory))
    assert len(rows) == len(ROWS)
    assert rows[2].priority == 100 and rows[2].changed
    assert rows[10].priority == 0 and not rows[10].changed
    assert rows[1].priority == 0 and not rows[1].changed


@pytest.mark.parametrize("threshold", ["1000", "1"])
def test_next_batch_is_the_best_per_kind(spark, threshold):
    rows = [
        (i, i, "hash" if i % 3 else "analyze", "queued" if i % 5 else "done", 0) for i in range(200)
    ]
    ledger = make(spark, rows).withColumn("priority", (F.col("work_id") * 7 % 4).cast("int"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        got = work.next_work_batch(ledger, size=10).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    for kind in ("hash", "analyze"):
        waiting = [(-(i * 7 % 4), i) for i, _, k, s, _ in rows if k == kind and s == "queued"]
        assert sorted(r.work_id for r in got if r.kind == kind) == sorted(
            i for _, i in sorted(waiting)[:10]
        )


def test_next_batch_has_every_kind_whatever_its_size(spark):
    kinds = ["hash", "thumbnail", None]
    rows = [(i, i, kinds[i % 3], "queued", 0) for i in range(9)]
    ledger = make(spark, rows).withColumn("priority", F.col("work_id").cast("int"))
    for size in (2, 1000, 1001):
        got = work.next_work_batch(ledger, size)
        assert got.columns == ledger.columns
        found = sorted(r.work_id for r in got.collect())
        assert found == (list(range(3, 9)) if size == 2 else list(range(9)))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1")
    try:
        assert sorted(r.work_id for r in work.next_work_batch(ledger, 2).collect()) == list(range(3, 9))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_next_batch_limits_before_the_shuffle(spark):
    ledger = make(spark, ROWS)
    plan = work.next_work_batch(ledger, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_outcomes(spark, ledger, inventory):
    told = spark.createDataFrame(
        [(3, False, "boom"), (4, True, None), (1, True, None)],
        "work_id bigint, success boolean, message string",
    )
    after = work.record_outcomes(ledger, told, inventory, AT)
    rows = by_id(after)
    assert len(rows) == len(ROWS)
    assert (rows[3].status, rows[3].attempts, rows[3].error) == ("error", 3, "boom")
    assert (rows[4].status, rows[4].attempts, rows[4].finished_at) == ("done", 0, AT)
    assert (rows[7].status, rows[7].attempts, rows[7].error) == (
        "retry", 1, "File not found in database",
    )
    # Not running, so not touched.
    assert rows[1].status == "pending" and rows[1].finished_at is None
    assert tuple(work.outcome_totals(ledger, after).first()) == (1, 2)


def test_outcome_told_twice_counts_once(spark, ledger, inventory):
    told = spark.createDataFrame(
        [(4, False, "x"), (4, True, None), (3, False, "a"), (3, False, "a")],
        "work_id bigint, success boolean, message string",
    )
    after = work.record_outcomes(ledger, told, inventory, AT)
    assert after.count() == len(ROWS)
    rows = by_id(after)
    assert rows[4].status == "done" and (rows[3].status, rows[3].attempts) == ("error", 3)


def test_running_work_without_outcome_goes_on(spark, ledger, inventory):
    nothing = spark.createDataFrame([], "work_id bigint, success boolean, message string")
    rows = by_id(work.record_outcomes(ledger, nothing, inventory, AT))
    assert rows[3].status == "running" and rows[3].finished_at is None


def test_failure_is_counted_once_in_a_full_round(spark, inventory):
    """Three attempts allowed means three attempts made."""
    ledger = make(spark, [(1, 10, "hash", "pending", 0)])
    tries = 0
    while True:
        ledger = work.promote(ledger).drop("changed")
        batch = work.next_work_batch(ledger)
        if batch.isEmpty():
            break
        tries += 1
        ledger = work.start_work(ledger, batch, "w", AT)
        told = batch.select("work_id", F.lit(False).alias("success"), F.lit("no").alias("message"))
        rows = work.record_outcomes(ledger, told, inventory, AT).collect()
        ledger = spark.createDataFrame(rows, LEDGER)
    assert tries == 3
    assert ledger.first().status == "error"


def test_stats(ledger):
    got = {(r.kind, r.status): r["items"] for r in work.ledger_stats(ledger).collect()}
    assert got[("hash", "running")] == 2 and sum(got.values()) == len(ROWS)
    wide = {r.kind: r for r in work.ledger_stats_by_kind(ledger).collect()}
    for (kind, status), items in got.items():
        assert wide[kind][status] == items
    assert wide["analyze"]["pending"] == 0
    assert set(wide["hash"].asDict()) == {"kind", *STATUSES}


def test_prune_and_left(ledger, inventory):
    assert {r.work_id for r in work.prune_orphans(ledger, inventory).collect()} == {
        1, 2, 3, 4, 5, 6, 8, 9,
    }
    assert {r.work_id for r in work.work_left(ledger).collect()} == {1, 2, 3, 4, 5, 7, 10}


def test_known_values(spark):
    odd = make(spark, [(1, 1, "hash", "pending", 0), (2, 1, "dance", "pending", 0), (3, 1, "hash", "gone", 0)])
    assert {r.work_id for r in odd.filter(work.known_values(odd)).collect()} == {1}
