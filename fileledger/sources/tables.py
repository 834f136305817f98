"""Inventory and manifest tables: reading, layout, versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger.operators.merge import merge_results
from fileledger.schema import INVENTORY, MANIFEST
from fileledger.session import cut_lineage

#: File ids of a directory of an inventory in ranges.
RANGE_IDS = 1_000_000


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVENTORY).parquet(path)


def read_inventory_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """An inventory kept in a database; give `partitionColumn`, bounds and `numPartitions`."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_bucketed(inventory: DataFrame, path: str, buckets: int, name: str | None = None, mode: str = "error") -> str:
    """Write an inventory dealt by path into sorted buckets; returns the table's name in the catalog.

    Joins on the path then move the other side only, to as many partitions as there are buckets. Take at
    least as many as `spark.sql.shuffle.partitions`; with fewer Spark may deal both sides anew. With
    `mode` "append" rows are added to the buckets of a table written before. `path` is where the files
    lie; another session finds them by `open_bucketed`.
    """
    name = name or f"inventory_{uuid.uuid4().hex}"
    # Dealt first, so that a task writes whole buckets and not a file for each.
    dealt = inventory.repartition(buckets, "path")
    dealt.write.mode(mode).bucketBy(buckets, "path").sortBy("path").option("path", path).saveAsTable(name)
    return name


def open_bucketed(spark: SparkSession, path: str, buckets: int, layout: str = INVENTORY, name: str | None = None) -> DataFrame:
    """The bucketed inventory at `path`, as written by `write_bucketed` with this number of buckets."""
    name = name or f"inventory_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromDDL(layout))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path :path) "
        f"CLUSTERED BY (path) SORTED BY (path) INTO {int(buckets)} BUCKETS",
        args={"path": path},
    )
    return spark.table(name)


def write_ranges(inventory: DataFrame, path: str, range_ids: int = RANGE_IDS, mode: str = "error") -> None:
    """Write an inventory in directories of `range_ids` consecutive file ids each."""
    ranged = inventory.withColumn("id_range", _range_of("file_id", range_ids))
    # A range is one task's file, however the rows lay before.
    ranged.repartition("id_range").write.mode(mode).partitionBy("id_range").parquet(path)


def read_ranges(spark: SparkSession, path: str, layout: str = INVENTORY) -> DataFrame:
    """An inventory written by `write_ranges`; conditions on `id_range` leave out whole directories."""
    return spark.read.schema(f"{layout}, id_range bigint").parquet(path)


def update_ranges(
    spark: SparkSession, path: str, results: DataFrame, *columns: str, range_ids: int = RANGE_IDS, layout: str = INVENTORY
) -> list[int]:
    """Fold results into the inventory at `path` and rewrite only the ranges that have some; returns them.

    Other ranges are neither read nor touched. The new rows are written down before old ones go, and
    each range is exchanged as a whole, so a job broken off leaves ranges old or new; run again, it
    gives the same table. Ids the inventory does not have are left out. One update at a time. The
    list of ranges, one number for every `range_ids` ids, passes through the driver.
    """
    known = read_ranges(spark, path, layout)
    of_results = results.select(_range_of("file_id", range_ids).alias("id_range")).filter("id_range is not null").distinct()
    ranges = sorted(r[0] for r in of_results.collect())
    if not ranges:
        return []
    merged = cut_lineage(merge_results(known.filter(F.col("id_range").isin(ranges)), results, *columns))
    changed = merged.repartition("id_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    changed.partitionBy("id_range").parquet(path)
    return ranges


def _range_of(file_id: str, range_ids: int) -> Column:
    return F.floor(F.col(file_id) / range_ids).cast("bigint")


def in_inventory_layout(files: DataFrame) -> DataFrame:
    """Exactly the inventory's columns, absent ones null."""
    layout = T.StructType.fromDDL(INVENTORY)
    return files.select(
        *[
            (F.col(f.name) if f.name in files.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in layout
        ]
    )


def append_manifest(moved: DataFrame, path: str) -> None:
    """Record quarantined files (one row each, in place of a side file next to every file)."""
    wanted = [field.split()[0] for field in MANIFEST.split(", ")]
    moved.select(*wanted).write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def write_snapshot(table: DataFrame, base: str) -> str:
    """Write a new version of a table that may be made from the one before; returns its path.

    Nothing is overwritten: readers of the earlier version, this job among them, keep their files.
    """
    latest = latest_snapshot(table.sparkSession, base)
    version = int(latest.rsplit("=", 1)[1]) + 1 if latest else 1
    path = f"{base}/version={version}"
    # A version left unfinished by a failed job is no version yet.
    table.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    """Path of the newest finished version, or None."""
    if not table_exists(spark, base):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in system.listStatus(folder)]
    versions = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    for version in reversed(versions):
        path = f"{base}/version={version}"
        if table_exists(spark, f"{path}/_SUCCESS"):
            return path
    return None


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
