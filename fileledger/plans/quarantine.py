"""Quarantine and restore plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.names import base_name
from fileledger.functions.times import ntz
from fileledger.operators.heavy_keys import SLICE_ROWS, join_groups
from fileledger.session import cut_lineage

# Reasons given for a file that is left alone.
NOT_IN_INVENTORY = "not found"
NOT_ON_DISK = "file not found"
NO_RECORD = "Quarantine metadata not found"
ORIGINAL_EXISTS = "Original path already exists"


#: Added to a run's folder for files that share a name.
SAME_NAME = "_same"


def run_folder(root: str, run_ts: datetime) -> str:
    return f"{root.rstrip('/')}/{run_ts.strftime('%Y%m%d_%H%M%S')}"


def _or_nowhere(path: Column, row_id: Column) -> Column:
    """The path, or for rows without one a text no path equals, each row its own.

    Null keys would all go to one task of an outer join.
    """
    return F.coalesce(path, F.concat(F.lit("\0"), row_id.cast("string")))


def _on_disk(listing: DataFrame, column: str) -> DataFrame:
    return listing.select(F.col("path").alias(column)).distinct().withColumn("_exists", F.lit(True))


def quarantine_plan(
    items: DataFrame,
    inventory: DataFrame,
    listing: DataFrame,
    root: str,
    run_ts: datetime,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """For each file id asked for: where it would go, or why it stays.

    A file whose name no other has goes to the run's folder. Files of one name would meet there; each
    of those goes to a folder of its own, named by its id, in a folder beside the run's. So no two
    files have one destination, whatever they are called.
    """
    asked = (
        items.filter(F.col("file_id").isNotNull())
        .select("file_id")
        .distinct()
        .join(inventory.select("file_id", "path"), "file_id", "left")
    )
    looked_at = asked.withColumn("_place", _or_nowhere(F.col("path"), F.col("file_id"))).join(
        _on_disk(listing, "_place"), "_place", "left"
    )
    reason = F.when(F.col("path").isNull(), F.lit(NOT_IN_INVENTORY)).when(
        F.col("_exists").isNull(), F.lit(NOT_ON_DISK)
    )
    # Looked at twice below, so written down: the joins above are then done once.
    judged = cut_lineage(looked_at.select("file_id", "path", reason.alias("reason"))).withColumn(
        "_name", F.when(F.col("reason").isNull(), base_name(F.col("path")))
    )
    shared_names = (
        judged.filter(F.col("_name").isNotNull())
        .groupBy("_name")
        .agg(F.count("*").alias("_same_name"))
        .filter(F.col("_same_name") > 1)
    )
    folder = run_folder(root, run_ts)
    plain = F.concat(F.lit(folder + "/"), F.col("_name"))
    own = F.concat(F.lit(folder + SAME_NAME + "/"), F.col("file_id"), F.lit("/"), F.col("_name"))
    return join_groups(
        judged, shared_names, "_name", "_same_name", "file_id", "left", slice_rows
    ).select(
        "file_id",
        "path",
        F.when(F.col("_same_name").isNotNull(), own)
        .otherwise(plain)
        .alias("destination"),
        F.when(F.col("reason").isNull(), F.lit("moved")).otherwise(F.lit("skipped")).alias("action"),
        "reason",
    )


def action_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("files"))


def manifest_of(plan: DataFrame, run_ts: datetime) -> DataFrame:
    """Records of the files a plan moves."""
    return plan.filter(F.col("action") == "moved").select(
        F.col("path").alias("original_path"),
        F.col("destination").alias("quarantine_path"),
        ntz(run_ts).alias("quarantine_date"),
        "file_id",
    )


def list_quarantine(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """The records, and whether the quarantined file is still there."""
    return manifest.join(_on_disk(listing, "quarantine_path"), "quarantine_path", "left").select(
        "original_path",
        "quarantine_path",
        "quarantine_date",
        "file_id",
        F.coalesce("_exists", F.lit(False)).alias("exists"),
    )


def restore_plan(
    requests: DataFrame, manifest: DataFrame, listing: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """For each quarantined path asked for: where it goes back to, or why it does not.

    Of several files that came from one path only the first, by quarantine path, can go back.
    """
    # A path recorded more than once holds the file recorded last.
    records = (
        manifest.groupBy("quarantine_path")
        .agg(F.max(F.struct("quarantine_date", "original_path")).alias("_last"))
        .select("quarantine_path", "_last.original_path")
    )
    asked = (
        requests.filter(F.col("quarantine_path").isNotNull())
        .select("quarantine_path")
        .distinct()
        .join(records, "quarantine_path", "left")
    )
    looked_at = asked.withColumn(
        "_place", _or_nowhere(F.col("original_path"), F.col("quarantine_path"))
    ).join(_on_disk(listing, "_place"), "_place", "left")
    reason = F.when(F.col("original_path").isNull(), F.lit(NO_RECORD)).when(
        F.col("_exists"), F.lit(ORIGINAL_EXISTS)
    )
    judged = cut_lineage(
        looked_at.select("quarantine_path", "original_path", reason.alias("_reason"))
    ).withColumn("_target", F.when(F.col("_reason").isNull(), F.col("original_path")))
    rivals = (
        judged.filter(F.col("_target").isNotNull())
        .groupBy("_target")
        .agg(F.count("*").alias("_rivals"), F.min("quarantine_path").alias("_first"))
        .filter(F.col("_rivals") > 1)
    )
    beaten = F.col("_first").isNotNull() & (F.col("_first") != F.col("quarantine_path"))
    final = F.when(beaten, F.lit(ORIGINAL_EXISTS)).otherwise(F.col("_reason"))
    return join_groups(
        judged, rivals, "_target", "_rivals", "quarantine_path", "left", slice_rows
    ).select(
        "quarantine_path",
        "original_path",
        F.when(final.isNull(), F.lit("restored")).otherwise(F.lit("refused")).alias("action"),
        final.alias("reason"),
    )
