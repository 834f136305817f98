"""Files with equal content: groups, members and the nested report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions.times import epoch_micros
from fileledger.operators.heavy_keys import SLICE_ROWS, join_groups
from fileledger.operators.membership import among
from fileledger.operators.ordering import in_order, number_in_groups
from fileledger.session import cut_lineage

#: Files listed in one row of the nested report; a larger group continues on further rows.
PAGE_FILES = 10_000


def duplicate_groups(inventory: DataFrame, min_size: int = 0) -> DataFrame:
    """One row per hash held by at least two files of `min_size`, largest total first.

    The copy to keep is the oldest of all files with that hash, whatever `min_size` says; an
    unknown creation time counts as oldest and the lower id breaks ties. Counts, sums and the
    oldest file's id are combined before the shuffle, so a group of any size travels as one row per
    map task, and in buffers of fixed size, so nothing is sorted for it.
    """
    groups = _with_keepers(_groups(inventory, min_size), inventory).select(
        "sha256", "count", "total_size", "wasted_size", "keeper_id", "keeper_path", "suggestion"
    )
    # Spread by the keeper: by hash they lie spread already, and the shuffle would be left out.
    return in_order(groups, "keeper_id", F.desc("total_size"), "sha256")


def _groups(inventory: DataFrame, min_size: int) -> DataFrame:
    """One row per hash of at least two files: counts, the total and the id of the oldest file."""
    large_enough = F.col("size") >= min_size
    # (time, id) as one number, ids counted from the lowest there is, unknown times before all
    # others. The smallest number of 38 digits is kept in place; pairs would have to be sorted.
    age = F.coalesce(epoch_micros(F.col("created")), F.lit(-(10**18)))
    lowest = F.lit(str(2**63)).cast("decimal(20,0)")
    ids = F.lit(str(2 * 10**19)).cast("decimal(20,0)")
    place = age.cast("decimal(19,0)") * ids + (F.col("file_id").cast("decimal(20,0)") + lowest)
    keeper_id = (F.pmod(F.col("oldest"), ids) - lowest).cast("bigint")
    return (
        inventory.groupBy("sha256")
        .agg(
            F.count_if(large_enough).alias("count"),
            F.sum(F.when(large_enough, F.col("size"))).alias("total_size"),
            # None for files without hash. So these are left out behind the sums, and the hash is
            # not worked out once more for a filter before them.
            F.count("sha256").alias("members"),
            F.min(place.cast("decimal(38,0)")).alias("oldest"),
        )
        .filter((F.col("count") > 1) & (F.col("members") > 0))
        .select("sha256", "count", "total_size", "members", keeper_id.alias("keeper_id"))
    )


def _with_keepers(groups: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add what is told of the file to keep, looked up by id, one row per group.

    The groups are written down. Then their keepers are known, and a filter of these ids keeps other
    files from being shuffled for the lookup.
    """
    groups = cut_lineage(groups)
    keepers = inventory.select(
        F.col("file_id").alias("keeper_id"), F.col("size").alias("_size"), F.col("path").alias("keeper_path")
    )
    keepers = among(keepers, "keeper_id", groups.select("keeper_id"))
    return (
        groups.join(keepers, "keeper_id")
        .withColumn("wasted_size", F.col("total_size") - F.col("_size"))
        .withColumn("suggestion", F.concat(F.lit("Keep oldest: "), "keeper_path"))
        .drop("_size")
    )


def _members(
    inventory: DataFrame, min_size: int, slice_rows: int, *about_group: str
) -> DataFrame:
    """All files of the duplicate groups, with the named columns of their group."""
    files = inventory.select("sha256", "file_id", "path", "name", "size", "created", "modified")
    groups = _groups(inventory, min_size)
    if {"wasted_size", "suggestion"} & set(about_group):
        groups = _with_keepers(groups, inventory)
    groups = groups.select("sha256", "members", "keeper_id", *about_group)
    return join_groups(
        files, groups, "sha256", "members", row_id="file_id", slice_rows=slice_rows
    ).withColumn("is_keeper", F.col("file_id") == F.col("keeper_id"))


def duplicate_members(
    inventory: DataFrame, min_size: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every file of every duplicate group as a flat row, groups by total size, oldest file first.

    The sort ends on the file id, so its ranges cut through a group of any size.
    """
    members = _members(inventory, min_size, slice_rows, "total_size")
    return in_order(
        members, "file_id", F.desc("total_size"), "sha256", F.asc_nulls_first("created"), "file_id"
    ).select("sha256", "file_id", "path", "name", "size", "created", "modified", "is_keeper")


def removable_files(
    inventory: DataFrame, min_size: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """All copies but the ones to keep: (file_id, path, size)."""
    return (
        _members(inventory, min_size, slice_rows)
        .filter(~F.col("is_keeper"))
        .select("file_id", "path", "size")
    )


def _numbered(
    inventory: DataFrame, min_size: int, slice_rows: int, *about_group: str
) -> DataFrame:
    members = _members(inventory, min_size, slice_rows, *about_group).drop("members", "is_keeper")
    return number_in_groups(
        members, "sha256", ["created", "file_id"], "number", "file_id", slice_rows
    )


def numbered_members(
    inventory: DataFrame, min_size: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every file of every duplicate group with its place in it: 1 is to be kept, the others not."""
    return _numbered(inventory, min_size, slice_rows).select("sha256", "number", "file_id", "path")


def find_duplicates(
    inventory: DataFrame,
    min_size: int = 0,
    page_files: int = PAGE_FILES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Duplicate groups with their files nested, oldest first.

    A group of up to `page_files` is one row. A larger one goes on over further rows, page after
    page, none of which has to hold the whole group. Totals and suggestion are on page 0 only, so
    sums over the report are those over the groups. The members are written down once, with their
    number in the group, when this is called.
    """
    group = ["sha256", "count", "total_size", "wasted_size", "keeper_id", "suggestion"]
    numbered = _numbered(
        inventory, min_size, slice_rows, "count", "total_size", "wasted_size", "suggestion"
    )
    listed = F.struct("created", "file_id", "path", "name", "size", "modified")
    nested = (
        numbered.withColumn("page", F.floor((F.col("number") - 1) / page_files))
        .groupBy(*group, "page")
        .agg(F.sort_array(F.collect_list(listed)).alias("files"))
    )
    first = F.col("page") == 0
    return nested.orderBy(F.desc("total_size"), "sha256", "page").select(
        "sha256",
        "page",
        *[F.when(first, F.col(c)).alias(c) for c in ("count", "total_size", "wasted_size")],
        "keeper_id",
        "files",
        F.when(first, F.col("suggestion")).alias("suggestion"),
    )


def files_sharing_a_size(inventory: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Files whose size occurs more than once: only these can be duplicates, so only these need
    a hash if nothing but the duplicate report is wanted."""
    sized = inventory.filter(F.col("size").isNotNull())
    sizes = sized.groupBy("size").agg(F.count("*").alias("same_size"))
    shared = sizes.filter(F.col("same_size") > 1)
    return join_groups(
        sized, shared, "size", "same_size", row_id="file_id", slice_rows=slice_rows
    ).select(*inventory.columns)
