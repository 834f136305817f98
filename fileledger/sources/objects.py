"""Trees on object stores and other file systems that are not mounted: listing and hashing whole.

File-based readers leave out empty files and names that begin with a dot or underscore; here every
file has a row. Folders are listed in tasks, round by round, through Arrow's file systems (`s3://`,
`gs://`, `hdfs://`, `file://` or a plain path).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.session import cut_lineage
from fileledger.sources.content import CHUNK_BYTES, spread_by_size

_LISTED = "path string, is_folder boolean, size bigint, modified timestamp, error string"
_FRAME_ROWS = 10_000


def _listing(root: str):
    def rows(folders: Iterator[str]) -> Iterator[tuple]:
        system, _ = pyarrow.fs.FileSystem.from_uri(root)
        is_local = isinstance(system, pyarrow.fs.LocalFileSystem)
        for folder in folders:
            try:
                for entry in system.get_file_info(pyarrow.fs.FileSelector(folder)):
                    is_folder = entry.type == pyarrow.fs.FileType.Directory
                    if is_folder and is_local and os.path.islink(entry.path):
                        continue  # what it links to is listed where it lies
                    is_file = entry.type == pyarrow.fs.FileType.File
                    problem = None if is_folder or is_file else "not a regular file"
                    yield entry.path, is_folder, entry.size if is_file else None, entry.mtime, problem
            except OSError as problem:  # a folder that can't be read is a row, not a gap
                yield folder, False, None, None, str(problem)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for row in rows(path for batch in batches for path in batch["path"]):
            held.append(row)
            if len(held) >= _FRAME_ROWS:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    return body


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _LISTED.split(", ")])
    frame["modified"] = pd.to_datetime(frame["modified"], utc=True)
    return frame.astype({"size": "Int64"})


def list_objects(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, size, modified, error) of every file below `root`; what is no file has an error.

    A round lists the folders that the one before has found, spread over the tasks; one flat folder
    is listed by one task, as a store gives out its names one after the other.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    _, top = pyarrow.fs.FileSystem.from_uri(root)
    folders = spark.sql("SELECT :top AS path", args={"top": top})
    found: DataFrame | None = None
    while True:
        seen = cut_lineage(folders.repartition(tasks, "path").mapInPandas(_listing(root), _LISTED))
        files = seen.filter(~F.col("is_folder")).drop("is_folder")
        found = files if found is None else found.unionByName(files)
        folders = seen.filter("is_folder").select("path")
        if folders.isEmpty():
            return found


def hash_objects(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, size, sha256, error) of every file below `root`, of any size, read in chunks.

    What could not be listed or read has an error in place of the hash.
    """

    def digest(system: pyarrow.fs.FileSystem, path: str) -> str:
        found = hashlib.sha256()
        with system.open_input_stream(path) as stream:
            while chunk := stream.read(CHUNK_BYTES):
                found.update(chunk)
        return found.hexdigest()

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            hashes, errors = [], []
            for path, error in zip(batch["path"], batch["error"]):
                try:
                    hashes.append(None if error else digest(system, path))
                    errors.append(error)
                except OSError as problem:  # a broken file must not end the job
                    hashes.append(None)
                    errors.append(str(problem))
            yield pd.DataFrame(
                {"path": batch["path"], "size": batch["size"].astype("Int64"), "sha256": hashes, "error": errors}
            )

    listed = list_objects(spark, root, tasks).select("path", "size", "error")
    return spread_by_size(listed, "path", tasks).mapInPandas(
        body, "path string, size bigint, sha256 string, error string"
    )
