"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    count: str,
    row_id: str,
    how: str = "inner",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Join rows to `groups`, which has one row per key and its row count in `count`.

    Pass `groups` with no more columns than are used afterwards. Rows of a heavy key, one with more
    than `slice_rows` rows, are spread over slices of about that many by `row_id`, and the group's
    single row is repeated once per slice, so no task gets a whole heavy group. Adaptive execution
    would not do this: the aggregation below `groups` keeps it from splitting the join. Only the
    heavy keys are broadcast, one for every `slice_rows` rows of the table at most.
    """
    slices = F.ceil(F.col(count) / slice_rows).cast("int")
    is_heavy = F.col(count) > slice_rows
    # The group's other columns go into the hash below. So this is the same aggregation as in
    # `groups`, no column of it pruned, and its shuffle is reused.
    others = [c for c in groups.columns if c != key]
    heavy = groups.filter(is_heavy).select(
        key, slices.alias("_slices"), F.xxhash64(*others).alias("_salt")
    )
    # Rows without a key match nothing, so they may lie anywhere.
    spread_over = F.when(F.col(key).isNull(), 1 << 20).otherwise(F.coalesce("_slices", F.lit(1)))
    spread = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(row_id, "_salt"), spread_over).cast("int")
    )
    needed = F.when(is_heavy, slices).otherwise(1)
    copies = groups.withColumn("_slice", F.explode(F.sequence(F.lit(0), needed - 1)))
    return (
        spread.drop("_slices", "_salt").join(copies, [key, "_slice"], how).drop("_slice")
    )
