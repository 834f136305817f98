"""File content: chunked reading of mounted files, and object stores through `binaryFile`."""

from __future__ import annotations

import hashlib
import json
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger.operators.ordering import number_rows

# Fixed value: bytes read at a time; digests do not depend on it.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 64 << 20
#: Files are told apart by their first and last block of this size before they are read whole.
EDGE_BYTES = 64 << 10
#: Files a task has open at once, so that it reads one while it waits for another.
PREFETCH = 4


def spread_by_path(files: DataFrame, tasks: int | None) -> DataFrame:
    """Hand out files evenly.

    The rows are tiny but stand for a lot of reading, so the number of tasks is given outright:
    left to itself, adaptive execution would merge them by row bytes into one task.
    """
    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "path")


def spread_by_size(files: DataFrame, row_id: str, tasks: int | None) -> DataFrame:
    """Hand out files so that tasks have about the same number of bytes to read.

    Numbered from the largest down and dealt in turn: the largest files go to tasks of their own, and
    each task gets as many of every size. A file without size comes last. `files` has `size`.
    """
    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    keyed = files.withColumn("_small", -F.coalesce("size", F.lit(-1)))
    numbered = number_rows(keyed, ["_small", row_id], "_number")
    return numbered.repartitionById(tasks, F.pmod("_number", F.lit(tasks)).cast("int")).drop("_small", "_number")


def sha256_of_file(path: str) -> str:
    return whole_file(path)["sha256"]


def edges_of_file(path: str, block: int = EDGE_BYTES) -> dict:
    """A digest of a file's first and last block, and the bytes read for it.

    A file of up to two blocks is read whole, so its `sha256` is known as well.
    """
    with open(path, "rb") as stream:
        head = stream.read(block)
        size = os.fstat(stream.fileno()).st_size
        if size > 2 * block:
            stream.seek(size - block)
            tail = stream.read(block)
        else:
            tail = stream.read()
    digest = hashlib.sha256(head + tail).hexdigest()
    whole = digest if size <= 2 * block and len(head) + len(tail) == size else None
    return {"edges": digest, "sha256": whole, "bytes_read": len(head) + len(tail)}


def whole_file(path: str) -> dict:
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
            size += len(chunk)
    return {"sha256": digest.hexdigest(), "bytes_read": size}


def _message(problem: Exception, path: str) -> str:
    return f"nothing lies at {path}" if isinstance(problem, FileNotFoundError) else str(problem)


def in_advance(work: Callable[[str], dict], paths: Iterable[str], most: int) -> Iterator[tuple[dict, str | None]]:
    """(result, None) or ({}, message) for each path in turn, with up to `most` of them worked on at once."""

    def one(path: str) -> tuple[dict, str | None]:
        try:
            return work(path), None
        except Exception as problem:  # a broken file must not end the job
            return {}, _message(problem, path)

    if most < 2:
        yield from map(one, paths)
        return
    with ThreadPoolExecutor(most) as pool:
        waiting: deque = deque()
        for path in paths:
            waiting.append(pool.submit(one, path))
            if len(waiting) >= most:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def enrich_files(
    files: DataFrame, work: Callable[[str], dict], columns: str, tasks: int | None = None, prefetch: int = 1
) -> DataFrame:
    """Run `work` on the path of every file: (file_id, the columns it gives, error).

    A file on which it fails has nulls and the message; the job goes on. With `prefetch` a task works
    on as many files at once, in threads.
    """
    given = T.StructType.fromDDL(columns).names

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(in_advance(work, batch["path"], prefetch))
            results, errors = [r for r, _ in found], [e for _, e in found]
            yield pd.DataFrame(
                {
                    "file_id": batch["file_id"],
                    **{c: pd.Series([r.get(c) for r in results], dtype="object") for c in given},
                    "error": errors,
                }
            )

    if "size" in files.columns:
        spread = spread_by_size(files.select("file_id", "path", "size"), "file_id", tasks)
    else:
        spread = spread_by_path(files.select("file_id", "path"), tasks)
    return spread.mapInPandas(
        body, f"file_id bigint, {columns}, error string"
    )


def hash_mounted(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file_id, sha256, error) for files the executors can open; any size, empty and hidden too."""
    return enrich_files(
        files, lambda path: {"sha256": sha256_of_file(path)}, "sha256 string", tasks, PREFETCH
    )


def edges_mounted(files: DataFrame, tasks: int | None = None, block: int = EDGE_BYTES) -> DataFrame:
    """(file_id, edges, sha256, bytes_read, error) from the first and last block of each file."""
    columns = "edges string, sha256 string, bytes_read bigint"
    return enrich_files(files, lambda path: edges_of_file(path, block), columns, tasks, PREFETCH)


def whole_mounted(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file_id, sha256, bytes_read, error) from each whole file."""
    return enrich_files(files, whole_file, "sha256 string, bytes_read bigint", tasks, PREFETCH)


def read_mounted(
    files: DataFrame,
    size_cap: int,
    extractors: Mapping[str, Callable[[bytes], dict]],
    tasks: int | None = None,
) -> DataFrame:
    """Open each file once: text comes back as `content`, other kinds as a finished `document`.

    `files` has file_id, path, extractor. Size is looked at again before reading; a batch is sent
    on when it holds 64 MB.
    """
    extractors = dict(extractors)

    def one(path: str, extractor: str) -> tuple[bytes | None, str | None, bool, str | None]:
        try:
            if os.stat(path).st_size > size_cap:
                return None, None, True, None
            with open(path, "rb") as stream:
                raw = stream.read()
        except OSError as problem:
            if isinstance(problem, FileNotFoundError):
                return None, None, False, _message(problem, path)
            return None, json.dumps({"erro": str(problem)}, ensure_ascii=False), False, None
        if extractor == "text":
            return raw, None, False, None
        try:
            if extractor in extractors:
                document = extractors[extractor](raw)
            else:
                document = {"erro": f"no extractor installed for {extractor}"}
        except Exception as problem:  # a broken file must not end the job
            document = {"erro": str(problem)}
        return None, json.dumps(document, ensure_ascii=False, default=str), False, None

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "content", "document", "too_large", "error"]
        for batch in batches:
            rows, held = [], 0
            for file_id, path, extractor in batch[["file_id", "path", "extractor"]].itertuples(
                index=False
            ):
                row = (file_id, *one(path, extractor))
                rows.append(row)
                held += len(row[1] or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return spread_by_path(files.select("file_id", "path", "extractor"), tasks).mapInPandas(
        body,
        "file_id bigint, content binary, document string, too_large boolean, error string",
    )


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """Files below `root` on any Hadoop file system: path, size, modified, content.

    One row holds one file, so 2 GB is the ceiling. Spark leaves out empty files and names that
    start with a dot or underscore here: fine for hashing content, wrong for taking inventory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )
