"""Keeping an inventory up to date with a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fileledger.operators.scan import append_inventory, scan_inventory
from fileledger.session import cut_lineage
from fileledger.sources.directory import FORMAT, list_again, register
from fileledger.sources.tables import table_exists


def unread_path(inventory_path: str) -> str:
    """Where the paths lie that a run could not read."""
    return f"{inventory_path.rstrip('/')}.unread"


def _failed(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("error").isNotNull()).select("path")


def ingest_new_files(
    spark: SparkSession,
    root: str,
    inventory_path: str,
    checkpoint: str,
    follow_symlinks: bool = False,
    zone: str = "UTC",
    **options: str,
) -> StreamingQuery:
    """Add the files of `root` that came since the last run, then stop.

    The checkpoint remembers up to when the tree was looked at and belongs outside the tree. A
    batch that is run again after a failure finds its paths in the inventory and adds none twice.
    What could not be read is kept in a table beside the inventory (`unread_path`), and the next run
    looks at it again, whether it has changed or not.
    Where one branch of the tree holds most files below a single directory, `scan` and
    `append_inventory` spread the walk better: here a piece of the tree stays with its task.
    """
    register(spark)
    unread = unread_path(inventory_path)
    if table_exists(spark, unread):
        # Looked at as a whole, then written anew with what still can't be read.
        listed = cut_lineage(list_again(spark.read.parquet(unread).distinct()))
        append_inventory(scan_inventory(listed, follow_symlinks, zone), inventory_path)
        _failed(listed).write.mode("overwrite").parquet(unread)
    options.setdefault("pieces", str(max(64, 4 * spark.sparkContext.defaultParallelism)))
    changes = spark.readStream.format(FORMAT).options(**options).load(root)

    def add(batch: DataFrame, batch_id: int) -> None:
        seen = cut_lineage(batch)
        append_inventory(scan_inventory(seen, follow_symlinks, zone), inventory_path)
        _failed(seen).write.mode("append").parquet(unread)

    return (
        changes.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
