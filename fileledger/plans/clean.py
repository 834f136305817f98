"""Removal plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: paths shown before a removal is confirmed.
PREVIEW_PATHS = 10


def clean_plan(items: DataFrame) -> DataFrame:
    """The files a report wants deleted; items without a path are ignored."""
    return items.filter(F.col("path").isNotNull()).select(
        "file_id", "path", "size", F.lit("delete").alias("action")
    )


def clean_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")
    )


def clean_preview(plan: DataFrame) -> DataFrame:
    """The first ten paths, and how many more there are."""
    first = plan.select("path").orderBy("path").limit(PREVIEW_PATHS)
    shown = first.select(
        # Numbers at most ten rows.
        F.row_number().over(Window.orderBy("path")).alias("line"),
        F.concat(F.lit("  - "), "path").alias("text"),
    )
    more = (
        plan.agg(F.count("*").alias("files"))
        .filter(F.col("files") > PREVIEW_PATHS)
        .select(
            F.lit(PREVIEW_PATHS + 1).alias("line"),
            F.concat(
                F.lit("  ... and "), (F.col("files") - PREVIEW_PATHS).cast("string"), F.lit(" more")
            ).alias("text"),
        )
    )
    return shown.unionByName(more).orderBy("line")
