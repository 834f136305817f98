"""The first rows of groups by counting, against sorting them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fileledger.operators import ledger as work
from fileledger.operators.selection import last_of_first
from fileledger.schema import LEDGER


@pytest.mark.parametrize("window_rows", [1, 50, 1 << 16])
def test_last_of_first(spark, window_rows):
    pick = random.Random(window_rows)
    groups = {
        "dense": list(range(400)), "ties": [pick.randrange(3) for _ in range(300)], "one": [7], "same": [5] * 90,
        "wide": [pick.randrange(-(2**63), 2**63) for _ in range(200)], "far": [-(2**63), 2**63 - 1, 0, -1],
        "clustered": [10**12 + pick.randrange(9) for _ in range(150)] + [0] * 40,
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "kind string, value bigint").repartition(5)
    wanted = {k: pick.randrange(1, len(v) + 20) for k, v in groups.items()}
    asked = spark.createDataFrame(list(wanted.items()), "kind string, wanted bigint")
    for given, want in ((asked, wanted), (F.lit(60), dict.fromkeys(groups, 60))):
        found = {r.kind: tuple(r)[1:] for r in last_of_first(frame, "kind", given, window_rows).collect()}
        for kind, values in groups.items():
            last = sorted(values)[min(want[kind], len(values)) - 1]
            assert found[kind] == (len(values), last, sum(v < last for v in values))
    assert last_of_first(frame.limit(0), "kind", F.lit(3)).count() == 0


def queue(spark, rows):
    """A ledger of (work_id, kind, priority, status)."""
    frame = spark.createDataFrame(rows, "work_id bigint, kind string, priority int, status string")
    names = [c.split()[0] for c in LEDGER.split(", ")]
    missing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LEDGER.split(", ") if c.split()[0] not in frame.columns]
    return frame.select("*", *missing).select(*names)


@pytest.mark.parametrize("window_rows", [2, 1 << 16])
@pytest.mark.parametrize("size", [1, 3, 40, 5000])
def test_both_forms_of_the_next_batch_agree(spark, size, window_rows):
    pick = random.Random(size)
    kinds, priorities = ["hash", "hash", "hash", "analyze", "other", None], [None, 1, 5, 5, 10, 2, -(2**31), 2**31 - 1]
    rows = [(i, pick.choice(kinds), pick.choice(priorities), "queued" if i % 9 else "done") for i in range(600)]
    rows += [(1000 + i, "lonely", None, "queued") for i in range(4)]
    ledger = queue(spark, rows).repartition(4)
    small = work.next_work_batch(ledger, size)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(size) if size > 1000 else "1000")
    try:
        small = {r.work_id for r in small.collect()}
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")
        large = work.next_work_batch(ledger, size, window_rows)
        assert large.columns == ledger.columns
        got = large.collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want = set()
    for kind in {*kinds, "lonely"}:
        waiting = [(p is None, -(p or 0), i) for i, k, p, s in rows if k == kind and s == "queued"]
        want |= {i for _, _, i in sorted(waiting)[:size]}
    assert small == want
    assert len(got) == len(want) and {r.work_id for r in got} == want


def test_order_of_missing_priorities(spark):
    rows = [(i, "hash", p, "queued") for i, p in enumerate([None, 1, 5, None, 10, 2])]
    ledger = queue(spark, rows)
    for threshold in ("1000", "1"):
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
        try:
            assert {r.work_id for r in work.next_work_batch(ledger, 3).collect()} == {2, 4, 5}
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_a_large_batch_numbers_nothing(spark):
    ledger = queue(spark, [(i, "hash", i % 4, "queued") for i in range(50)])
    plan = work.next_work_batch(ledger, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "rangepartitioning" not in plan and "Window" not in plan
