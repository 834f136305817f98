"""The fixed reports over an inventory, and the dispatch by name."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions import metadata, sizes, times
from fileledger.operators.duplicates import find_duplicates
from fileledger.operators.ordering import in_order

# Fixed value: what the suffix of a temporary file ends with.
TEMP_SUFFIXES = (".tmp", ".bak", ".old", ".log", ".temp", ".swp", ".swo", "~")

DEFAULT_LARGE = 104857600
DEFAULT_DAYS = 365


# Every sort ends on a unique column: the order is the same on each run, and many files of one
# size are spread over several sort ranges.


def find_large(inventory: DataFrame, min_bytes: int = DEFAULT_LARGE) -> DataFrame:
    """Files of at least `min_bytes`, largest first."""
    large = inventory.filter(F.col("size") >= min_bytes).select(
        "file_id", "path", "name", "ext", "size",
        sizes.megabytes(F.col("size")).alias("size_mb"),
        "modified",
    )
    return large.orderBy(F.desc("size"), "file_id")


def find_old(inventory: DataFrame, days: int = DEFAULT_DAYS, *, as_of: datetime) -> DataFrame:
    """Files last accessed more than `days` before `as_of`, longest idle first."""
    cutoff = times.ntz(as_of - timedelta(days=days))
    old = inventory.filter(F.col("accessed") < cutoff).select(
        "file_id", "path", "name", "size", "accessed", "modified",
        times.whole_days(F.col("accessed"), times.ntz(as_of)).alias("days_idle"),
    )
    return old.orderBy("accessed", "file_id")


def find_temp(inventory: DataFrame) -> DataFrame:
    """Temporary files by suffix, largest first."""
    temporary = F.col("ext").rlike("(" + "|".join(map(re.escape, TEMP_SUFFIXES)) + r")\z")
    files = inventory.filter(temporary).select("file_id", "path", "name", "ext", "size", "modified")
    return files.orderBy(F.desc("size"), "file_id")


def find_empty(inventory: DataFrame) -> DataFrame:
    """Files without content, by path."""
    empty = inventory.filter(F.col("size") == 0).select(
        "file_id", "path", "name", "ext", "modified"
    )
    return empty.orderBy("path")


def search_metadata(inventory: DataFrame, keyword: str) -> DataFrame:
    """Files with the keyword in some string value of their metadata, by path."""
    found = inventory.filter(metadata.has_value_like(F.col("metadata"), keyword)).select(
        "file_id", "path", "name", "ext", "size", "metadata"
    )
    return in_order(found, "path", "path")


def analyze(
    inventory: DataFrame,
    kind: str,
    *,
    min_size: int = 0,
    limit: str = "100MB",
    days: int = DEFAULT_DAYS,
    keyword: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """A report by name: duplicates, large, old, temp, empty or search."""
    if kind == "duplicates":
        return find_duplicates(inventory, min_size)
    if kind == "large":
        return find_large(inventory, sizes.parse_size(limit))
    if kind == "old":
        return find_old(inventory, days, as_of=as_of or datetime.now())
    if kind == "temp":
        return find_temp(inventory)
    if kind == "empty":
        return find_empty(inventory)
    if kind == "search":
        if not keyword:
            raise ValueError("a search needs a keyword to look for")
        return search_metadata(inventory, keyword)
    raise ValueError(f"no report is called {kind!r}")
