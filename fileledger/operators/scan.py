"""From listings to inventory rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fileledger.functions import attrs, names, times
from fileledger.operators.ordering import number_rows
from fileledger.schema import INVENTORY
from fileledger.sources.directory import list_tree
from fileledger.sources.tables import in_inventory_layout, read_inventory, table_exists


def _accepted(follow_symlinks: bool):
    """True for what is taken in; null, which a filter takes for false, where that is not known."""
    regular = F.col("is_file") & F.col("error").isNull()
    return regular if follow_symlinks else regular & ~F.col("is_symlink")


def describe_files(
    listing: DataFrame,
    follow_symlinks: bool = False,
    zone: str = "UTC",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Accepted files with their name, suffix, size, times, attributes and owner.

    Columns named in `keep` go along.
    """
    accepted = listing.filter(_accepted(follow_symlinks))
    return accepted.withColumn("name", names.base_name(F.col("path"))).select(
        *keep,
        "path",
        "name",
        names.suffix(F.col("name")).alias("ext"),
        "size",
        times.from_epoch(F.col("ctime"), zone).alias("created"),
        times.from_epoch(F.col("mtime"), zone).alias("modified"),
        times.from_epoch(F.col("atime"), zone).alias("accessed"),
        attrs.attribute_names(F.col("attr_bits")).alias("attrs"),
        attrs.owner_or_unknown(F.col("owner")).alias("owner"),
    )


def scan_inventory(
    listing: DataFrame, follow_symlinks: bool = False, zone: str = "UTC"
) -> DataFrame:
    """Inventory rows of a listing, without ids: regular files that could be looked at."""
    return names.with_mime(describe_files(listing, follow_symlinks, zone))


def rejected_files(listing: DataFrame, follow_symlinks: bool = False) -> DataFrame:
    """What `scan_inventory` leaves out, and why."""
    return listing.filter(~F.coalesce(_accepted(follow_symlinks), F.lit(False))).select(
        "path",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("is_file"), F.lit("symbolic link"))
        .otherwise(F.lit("not a regular file"))
        .alias("reason"),
    )


def scan(
    spark: SparkSession, root: str, follow_symlinks: bool = False, zone: str = "UTC"
) -> DataFrame:
    """Inventory rows of everything below `root`."""
    return scan_inventory(list_tree(spark, root), follow_symlinks, zone)


def resume_new_files(files: DataFrame, known: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Files whose path the inventory does not hold; a path given twice comes out once.

    Known paths go first, on a usual run nearly all; what is left is reduced to one row a path, in the
    same shuffle. Of two rows for a path the smaller one stays, so a re-run takes the same row. With
    `ignore_case`, paths differing only in case are one path.
    """
    path = F.lower("path") if ignore_case else F.col("path")
    new = files.withColumn("_key", path).join(known.select(path.alias("_key")), "_key", "left_anti")
    row = F.min(F.struct(*files.columns)).alias("_row")
    return new.groupBy("_key").agg(row).select(*[F.col("_row")[c].alias(c) for c in files.columns])


def append_inventory(
    new_files: DataFrame, path: str, ingested_at: datetime | None = None
) -> DataFrame:
    """Append files whose path the inventory at `path` does not hold yet; returns what was added.

    Safe to run again after a failure: paths already written are not added twice. The added rows
    come back from the written numbers, so a ledger made of them has the same ids. One append at a
    time: two at once would give out the same numbers.
    """
    spark = new_files.sparkSession
    start = 1
    if table_exists(spark, path):
        known = read_inventory(spark, path)
        new_files = resume_new_files(new_files, known)
        start = (known.agg(F.max("file_id")).first()[0] or 0) + 1
    else:
        new_files = resume_new_files(new_files, spark.createDataFrame([], INVENTORY))
    now = ingested_at or datetime.now(timezone.utc).replace(tzinfo=None)
    numbered = in_inventory_layout(
        number_rows(new_files.drop("file_id"), [], "file_id", start).withColumn(
            "ingested_at", times.ntz(now)
        )
    )
    numbered.write.mode("append").parquet(path)
    return numbered


@dataclass(frozen=True)
class ScanResult:
    """What a scan saw: all files and their bytes, when it ran, and the rows it added."""

    total_files: int
    total_bytes: int
    started: datetime
    ended: datetime
    added: DataFrame

    @property
    def duration_seconds(self) -> float:
        return (self.ended - self.started).total_seconds()


def scan_into(
    files: DataFrame, path: str, ingested_at: datetime | None = None, clock: Callable[[], datetime] = datetime.now
) -> ScanResult:
    """Append new files like `append_inventory`, and tell what was seen.

    Files and bytes are counted while the rows pass, in the job that appends them, so nothing is read
    a second time for it. The totals are those of `scan_totals(files)`.
    """
    seen = Observation()
    counted = files.observe(seen, F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    started = clock()
    added = append_inventory(counted, path, ingested_at)
    ended = clock()
    try:
        totals = seen.get
    except Py4JJavaError:
        # Spark leaves the count out together with rows it knows to be none.
        total = scan_totals(files).first()
        totals = {"files": total["total_files"], "bytes": total["total_bytes"]}
    return ScanResult(totals["files"], totals["bytes"] or 0, started, ended, added)


def refresh_inventory(inventory: DataFrame, listing: DataFrame) -> DataFrame:
    """Inventory rows whose file a fresh listing still shows."""
    present = listing.filter("is_file").select("path")
    return inventory.join(present, "path", "left_semi").select(*inventory.columns)


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )
