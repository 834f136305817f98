"""Sorting and numbering rows, as a whole and inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileledger.operators.heavy_keys import SLICE_ROWS, join_groups
from fileledger.session import cut_lineage

# monotonically_increasing_id counts inside a task below this bit, and tasks above it.
_TASK_BIT = 33


def in_order(report: DataFrame, spread_by: str, *order: Column | str) -> DataFrame:
    """The result of joins or costly filters sorted as a whole, with `spread_by` its unique column.

    To cut the sort into ranges Spark looks at the rows once before it moves them, and runs all
    that lies below to get them. After this shuffle of the finished rows, which are few next to the
    inventory, that is a second look at shuffle files and not a second run. Where a report is a
    filter that reaches the scan, a second look at its columns is cheaper than moving rows twice.
    """
    return report.repartition(spread_by).orderBy(*order)


def number_rows(
    rows: DataFrame, order: Sequence[str], column: str, start: int = 1
) -> DataFrame:
    """Add consecutive numbers in the given ascending order, the same for every later reader.

    With no order the rows are numbered as they lie, and not shuffled.

    Each range of rows is numbered on its own and written down; then every range is shifted by the
    rows before it. Only the table of ranges, one row per task, is ever seen whole.
    """
    in_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    placed = cut_lineage(in_ranges.withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", _TASK_BIT))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    in_range = F.col("_place") - F.shiftleft("_range", _TASK_BIT)
    return (
        placed.join(F.broadcast(shifts), "_range")
        .withColumn(column, F.lit(start) + F.col("_shift") + in_range)
        .drop("_place", "_range", "_shift")
    )


def number_in_groups(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    column: str,
    row_id: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add each row's number inside its group, from 1, ascending in `order`.

    The same as row_number over a window by `key`, without taking any group into one task: the
    rows are numbered as a whole, and the first number of the group is taken off.
    """
    numbered = number_rows(rows.repartition(row_id), [key, *order], "_number")
    groups = numbered.groupBy(key).agg(
        F.min("_number").alias("_first"), F.count("*").alias("_group_rows")
    )
    return (
        join_groups(numbered, groups, key, "_group_rows", row_id, slice_rows=slice_rows)
        .withColumn(column, F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first", "_group_rows")
    )
