"""Directory trees as listings: a data source, a stream of changed files, and a rebalancing scan."""

from __future__ import annotations

import operator
import os
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from fileledger.schema import LISTING
from fileledger.session import cut_lineage
from fileledger.sources.walk import on_the_way, open_directory, plan_subtrees, stat_row, walk

FORMAT = "file_inventory"


_COLUMNS = [field.split()[0] for field in LISTING.split(", ")]

_TESTS: dict[type, Callable] = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    In: lambda value, values: value in values,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: operator.contains,
}


def _judge(condition: Filter, row: tuple) -> bool | None:
    """What SQL says of the condition; None is unknown."""
    if isinstance(condition, Not):
        found = _judge(condition.child, row)
        return None if found is None else not found
    value = row[_COLUMNS.index(condition.attribute[0])]
    if isinstance(condition, (IsNull, IsNotNull)):
        return (value is None) == isinstance(condition, IsNull)
    if value is None or condition.value is None:
        return None
    return _TESTS[type(condition)](value, condition.value)


def _judged_here(condition: Filter) -> bool:
    if isinstance(condition, Not):
        return _judged_here(condition.child)
    if type(condition) not in {*_TESTS, IsNull, IsNotNull} or condition.attribute[0] not in _COLUMNS:
        return False
    # A null among the values would make what is in none of them unknown.
    return not isinstance(condition, In) or None not in condition.value


class Subtree(InputPartition):
    """A directory to list, with or without what lies below its sub-directories.

    With `after`, only what changed since then, or lies in a directory that did.
    """

    def __init__(self, directory: str, deep: bool, renewed: bool, after: float | None):
        self.directory = directory
        self.deep = deep
        self.renewed = renewed
        self.after = after

    def rows(self) -> Iterator[tuple]:
        for path, error, renewed in walk(self.directory, self.deep, self.renewed, self.after):
            row = stat_row(path, error)
            changed = row[5]
            if self.after is None or renewed or changed is None or changed > self.after:
                yield row


def _checked_root(options) -> str:
    root = options.get("path")
    if not root or not os.path.isdir(root):
        raise FileNotFoundError(f"no directory to list at {root}")
    return root


class _Planning:
    def __init__(self, options):
        self.root = _checked_root(options)
        self.pieces = int(options.get("pieces", "64"))
        self.effort = int(options.get("planning_entries", "100000"))

    def subtrees(self, after: float | None = None) -> list[Subtree]:
        return [
            Subtree(*piece, after)
            for piece in plan_subtrees(self.root, self.pieces, self.effort, after)
        ]


class TreeReader(_Planning, DataSourceReader):
    """Conditions on any column are judged where the files lie: rows they reject are not sent. Those on
    the path alone go first, without looking at the file, and directories off the beginning of a path are not opened."""

    def __init__(self, options):
        super().__init__(options)
        self.of_path: list[Filter] = []
        self.others: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if not _judged_here(condition):
                yield condition
            elif getattr(condition, "attribute", None) == ("path",):
                self.of_path.append(condition)
            else:
                self.others.append(condition)

    def _prefix(self) -> str:
        """What all wanted paths begin with, as far as a single condition tells."""
        known = [c.value for c in self.of_path if isinstance(c, (StringStartsWith, EqualTo))]
        return max(known, key=len, default="")

    def partitions(self):
        prefix = self._prefix()
        return [s for s in self.subtrees() if on_the_way(s.directory, prefix)]

    def read(self, partition):
        blank = (None,) * (len(_COLUMNS) - 1)
        for path, error, _ in walk(partition.directory, partition.deep, prefix=self._prefix()):
            if all(_judge(c, (path, *blank)) for c in self.of_path):
                row = stat_row(path, error)
                if all(_judge(c, row) for c in self.others):
                    yield row


class ChangedFilesReader(_Planning, DataSourceStreamReader):
    """Files changed since the last batch: new, rewritten, moved in alone or with their directory.

    The offset is a time. File systems date changes by clocks of their own, some coarse, so the
    next batch looks back `settle_seconds` before this one. Files seen twice are sorted out by the append,
    which knows paths. A file system that does not date changes needs a full scan instead.
    """

    def __init__(self, options):
        super().__init__(options)
        self.settle = float(options.get("settle_seconds", "60"))

    def initialOffset(self):
        return {"changed": 0.0}

    def latestOffset(self):
        return {"changed": time.time() - self.settle}

    def partitions(self, start, end):
        return self.subtrees(start["changed"])

    def read(self, partition):
        return partition.rows()

    def commit(self, end):
        pass


class FileInventorySource(DataSource):
    """`spark.read.format("file_inventory").load(root)`, also as a stream.

    Keeps empty files and names starting with a dot or underscore, which file-based readers drop.
    Every executor has to see the tree under the same path.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return LISTING

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return ChangedFilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark push conditions to it, which it requires."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileInventorySource)


def list_where(
    spark: SparkSession,
    root: str,
    *,
    min_size: int | None = None,
    max_size: int | None = None,
    accessed_before: datetime | None = None,
    modified_after: datetime | None = None,
    below: str | None = None,
) -> DataFrame:
    """List what lies below `root` and is within the bounds, judged by the tasks that look at the files.

    Sizes include the bounds, times (UTC) don't; `below` is a directory. Entries without the value that
    a bound is about, as those that could not be looked at, are left out.
    """
    register(spark)
    listing = spark.read.format(FORMAT).load(root)

    def epoch(at: datetime) -> float:
        return at.replace(tzinfo=timezone.utc).timestamp()

    bounds = [
        (min_size, lambda: F.col("size") >= min_size),
        (max_size, lambda: F.col("size") <= max_size),
        (accessed_before, lambda: F.col("atime") < epoch(accessed_before)),
        (modified_after, lambda: F.col("mtime") > epoch(modified_after)),
        (below, lambda: F.col("path").startswith(below.rstrip("/") + "/")),
    ]
    for bound, condition in bounds:
        if bound is not None:
            listing = listing.filter(condition())
    return listing


FRAME_ROWS = 10_000


def _in_frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while held := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(held, columns=columns)


def _walk_within(budget: int):
    """Task body: walk the given directories until `budget` entries, hand the rest back."""

    def entries(directories: Iterator[str]) -> Iterator[tuple[str, bool, str | None]]:
        left = budget
        for directory in directories:
            waiting = [directory]
            while waiting:
                current = waiting.pop()
                if left <= 0:
                    yield current, True, None
                    continue
                folders, others = open_directory(current)
                try:
                    for path in others:
                        left -= 1
                        yield path, False, None
                except OSError as problem:
                    yield current, False, str(problem)
                left -= len(folders)
                waiting.extend(folders)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directories = (path for batch in batches for path in batch["path"])
        return _in_frames(entries(directories), ["path", "is_folder", "error"])

    return body


def _stat_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (
        stat_row(path, error)
        for batch in batches
        for path, error in zip(batch["path"], batch["error"])
    )
    columns = [field.split()[0] for field in LISTING.split(", ")]
    for listed in _in_frames(rows, columns):
        yield listed.astype({"size": "Int64", "attr_bits": "Int32"})


def list_again(paths: DataFrame) -> DataFrame:
    """Listing rows of the given files, and of everything below the given directories."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch["path"]:
                if os.path.isdir(path) and not os.path.islink(path):
                    yield from (stat_row(found, error) for found, error, _ in walk(path))
                elif os.path.lexists(path):  # what is gone by now is not missed
                    yield stat_row(path)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [field.split()[0] for field in LISTING.split(", ")]
        for listed in _in_frames(entries(batches), columns):
            yield listed.astype({"size": "Int64", "attr_bits": "Int32"})

    tasks = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(tasks, "path").mapInPandas(body, LISTING)


def list_tree(
    spark: SparkSession, root: str, tasks: int | None = None, entries_per_task: int = 200_000
) -> DataFrame:
    """List everything below `root`, whatever the shape of the tree.

    The tree is walked in rounds. A task stops after its share of entries and hands the directories
    it has not opened to the next round, where they are spread over all tasks again; the share
    doubles each round. Names are collected first and looked at in a second pass, spread by path,
    so one huge flat directory does not leave its `stat` calls to one task.
    """
    root = _checked_root({"path": root})
    tasks = tasks or spark.sparkContext.defaultParallelism
    rounds: list[DataFrame] = []
    folders = spark.sql("SELECT :root AS path", args={"root": root})
    while True:
        seen = cut_lineage(
            folders.repartition(tasks, "path").mapInPandas(
                _walk_within(entries_per_task), "path string, is_folder boolean, error string"
            )
        )
        rounds.append(seen.filter(~F.col("is_folder")))
        folders = seen.filter("is_folder").select("path")
        if folders.isEmpty():
            break
        entries_per_task *= 2
    names = rounds[0]
    for later in rounds[1:]:
        names = names.unionByName(later)
    return names.repartition(tasks, "path").mapInPandas(_stat_batches, LISTING)
