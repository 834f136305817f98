"""Folding the results of jobs back into an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_results(inventory: DataFrame, results: DataFrame, *columns: str) -> DataFrame:
    """The inventory with new values where `results` has them, by file id.

    A file with several results, as after a job begun again or of jobs that fill different columns,
    stays one row; column by column a value goes before none, and the larger of two counts. Write the
    outcome to a new place: the inventory is still being read while it is written, or
    rewrite only what changed by `sources.tables.update_ranges`.
    """
    # On the key of the join, so the two share one shuffle.
    fresh = results.groupBy("file_id").agg(
        *[F.max(c).alias(f"_new_{c}") for c in columns]
    )
    merged = inventory.join(fresh, "file_id", "left")
    return merged.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in inventory.columns
        ]
    )
