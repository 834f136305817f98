"""Files that are one JSON array each, read in ranges of bytes.

Where in a file a record begins depends on all that stands before: a bracket may be part of a string. So
each range first tells, for both cases, what it does to strings and nesting; the sums over the ranges
before tell which case holds; then each range gives out the records that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_BYTES = 32 << 20
#: Read first behind a range, for the rest of its last record.
AHEAD_BYTES = 4096
_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int32)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_OPEN, _CLOSE = 0x7B, 0x7D


def open_file(path: str) -> pa.NativeFile:
    """A file by its path as Spark writes it, in which nothing is encoded."""
    scheme, _, place = path.rpartition("file:")
    if not scheme and place != path:
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + place.lstrip("/"))
    system, place = pyarrow.fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(unquote(place))


def _escaped(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes stand behind an odd number of backslashes; `before` are those in front of the data."""
    place = np.arange(len(data))
    others = np.where(data != _BACKSLASH, place, -1)
    last = np.append(-1, np.maximum.accumulate(others)[:-1]) if len(data) else others
    run = place - 1 - last + np.where(last < 0, before, 0)
    return run % 2 == 1


def _backslashes_before(file: pa.NativeFile, at: int) -> int:
    """How many backslashes stand right in front of a place."""
    count = 0
    while at > 0:
        file.seek(max(0, at - 1024))
        part = file.read(at - max(0, at - 1024))
        run = len(part) - len(part.rstrip(b"\\"))
        count, at = count + run, at - len(part)
        if run < len(part):
            break
    return count


def scanned(data: np.ndarray, before: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is outside of strings, and the nesting behind it."""
    quotes = (data == _QUOTE) & ~_escaped(data, before)
    # A quote that opens is inside, one that closes is not; neither is a bracket.
    outside = (np.cumsum(quotes) + inside) % 2 == 0
    return outside, depth + np.cumsum(np.where(outside, _STEP[data], 0))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            with open_file(row["file"]) as file:
                before = _backslashes_before(file, row["start"])
                file.seek(row["start"])
                data = np.frombuffer(file.read(row["stop"] - row["start"]), np.uint8)
            quotes = int(((data == _QUOTE) & ~_escaped(data, before)).sum())
            steps = [int(scanned(data, before, inside, 0)[1][-1]) for inside in (False, True)]
            rows.append({"file": row["file"], "start": row["start"], "stop": row["stop"], "quotes": quotes, "outside": steps[0], "inside": steps[1]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "quotes", "outside", "inside"))]))


def _records(file: pa.NativeFile, start: int, stop: int, inside: bool, depth: int, step: int = 1 << 22) -> Iterator[bytes]:
    """The objects of the array that begin between start and stop; the last one may go on behind.

    Behind the range only the rest of that one is wanted. So little is read there at first, and each time twice as
    much, up to `step`: what is read grows with the range and its last object, not with the file.
    """
    at, held, begun, ahead = start, [], False, AHEAD_BYTES
    before = _backslashes_before(file, start)
    while True:
        file.seek(at)
        if at < stop:
            raw = file.read(min(step, stop - at))
        else:
            raw = file.read(min(step, ahead))
            ahead *= 2
        if not raw:
            return
        data = np.frombuffer(raw, np.uint8)
        outside, depths = scanned(data, before, inside, depth)
        first = (data == _OPEN) & outside & (depths == 2)
        last = (data == _CLOSE) & outside & (depths == 1)
        starts, ends = np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist()
        if begun:
            held.append(raw[: ends[0]] if ends else raw)
            if ends:
                yield b"".join(held)
                ends, begun = ends[1:], False
        if not begun:
            # Begun here and not behind the range.
            starts = [x for x in starts if at + x < stop]
            # A record of the range before may end here.
            ends = [x for x in ends if starts and x > starts[0]]
            for a, b in zip(starts, ends):
                yield raw[a:b]
            if len(starts) > len(ends):
                held, begun = [raw[starts[len(ends)] :]], True
        tail = len(raw) - len(raw.rstrip(b"\\"))
        before = tail + (before if tail == len(raw) else 0)
        inside = not bool(outside[-1])
        depth, at = int(depths[-1]), at + len(raw)
        if at >= stop and not begun:
            return


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["file"]) as file:
                held, size = [], 0
                for record in _records(file, row["start"], row["stop"], row["inside"], row["depth"]):
                    held.append(record)
                    size += len(record)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})


def read_arrays(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of the JSON arrays at `path`, one file or all of a folder, with the given columns.

    A file is cut every `range_bytes`; each range is looked at by one task, twice, and a record belongs to the range
    it begins in. Only numbers about ranges pass from the first look to the second. Elements that are
    no objects are left out, and an object that can't be read gives nulls. The files are opened by Arrow, from any file system that
    it knows; an empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select(F.col("path").alias("file"), "length", starts.alias("start"))
    ranges = ranges.select("file", "start", F.least("length", F.col("start") + range_bytes).alias("stop"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    spread = ranges.repartition(tasks, "file", "start")
    told = spread.mapInArrow(_summaries, "file string, start bigint, stop bigint, quotes bigint, outside bigint, inside bigint")
    # A few numbers for each range of a file.
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    step = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    placed = placed.withColumn("step", step).select(
        "file", "start", "stop", F.col("odd").alias("inside"), F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth")
    )
    records = placed.repartition(tasks, "file", "start").mapInArrow(_texts, "record binary")
    return records.select(F.from_json(F.col("record").cast("string"), schema).alias("r")).select("r.*")
