"""Count-min sketches of hashes over a whole table, and which counters have two or more.

Each task sends, for every row of counters, which counters its hashes touch once and which more
often; a merge per slice of counters adds them up. Such counts are never too low, so a hash with a
counter below two occurs once. Two is all that is asked, so counters stop there. The merged sketch
lies in the shared folder, from where tasks read it; it does not go through the driver.

Where hashes outgrow the counters a task can load, `repeated_filter` counts in as many counters as
hashes need, a slice at a time, and keeps a Bloom filter of those with two or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fileledger.llm import flat
from fileledger.llm.shared_files import new_folder, read_file, write_file

ROWS = 2
#: Most counters in a row: 2^29, of which a bit each is kept, 64 MB a row. With more hashes than
#: counters more hashes that occur once look repeated; the other way round never happens.
MOST_BITS = 29
_SLICE_BITS = 22
#: Hashes a task keeps before it sends their counters on.
_HELD = 1 << 21
#: Counters of a slice at most; three bytes hold a place in one.
_MOST_SLICE_BITS = 24
#: Places that a Bloom filter has for each hash.
_FILTER_ROWS = 2


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (flat.mix(hashes + np.uint64(row * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(sorted_values: np.ndarray, width: int) -> bytes:
    """Ascending numbers as differences, byte by byte of equal place: the upper ones are mostly zero."""
    steps = np.diff(sorted_values, prepend=0).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0]).astype(np.int64)


class Sketch(NamedTuple):
    """Where a merged sketch lies: a file per slice that has counters of two or more."""

    folder: str
    rows: int
    bits: int
    slices: tuple[int, ...]


def repeated_cells(
    documents: DataFrame,
    hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    expected: int,
    rows: int = ROWS,
    most_bits: int = MOST_BITS,
) -> Sketch:
    """For each row of counters, a bit for each that has two or more.

    A row has at least four counters per expected hash, and not over 2^`most_bits`.
    """
    bits = min(most_bits, max(16, (4 * expected).bit_length()))
    slice_bits = min(bits, _SLICE_BITS)

    def kept(number: int, more: np.ndarray) -> bytes:
        return np.packbits(more, bitorder="little").tobytes()

    return Sketch(*_merged(documents, hashes_of, rows, bits, slice_bits, kept))


class Filter(NamedTuple):
    """Where a Bloom filter of the counters of two or more lies: a file per slice that has any."""

    folder: str
    bits: int
    slice_bits: int
    filter_bits: int
    slices: tuple[int, ...]


def repeated_filter(
    documents: DataFrame,
    hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    expected: int,
    most_bits: int = MOST_BITS + 1,
) -> Filter:
    """A Bloom filter of the counters, in one row, that have two or more.

    There are at least 16 counters per expected hash, however many those are, as they are merged a
    slice at a time; the filter has not over 2^`most_bits` bits.
    """
    bits = max(16, (16 * expected).bit_length())
    slice_bits = min(_MOST_SLICE_BITS, max(16, bits - 8))
    # A byte for each slice at least.
    filter_bits = max(min(most_bits, max(16, (4 * expected).bit_length())), bits - slice_bits + 3)

    def kept(number: int, more: np.ndarray) -> bytes:
        cells = np.flatnonzero(more) | (number << slice_bits)
        out = np.zeros(1 << (filter_bits - (bits - slice_bits)), bool)
        for row in range(_FILTER_ROWS):
            out[_place(cells, row, filter_bits - (bits - slice_bits))] = True
        return np.packbits(out, bitorder="little").tobytes()

    folder, _, _, slices = _merged(documents, hashes_of, 1, bits, slice_bits, kept)
    return Filter(folder, bits, slice_bits, filter_bits, slices)


def _place(cells: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Where a row of a filter has its bit for a counter, in the part of the counter's slice."""
    return _cells(cells.view(np.uint64), row + 1, bits)


def _merged(
    documents: DataFrame,
    hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    rows: int,
    bits: int,
    slice_bits: int,
    kept: Callable[[int, np.ndarray], bytes],
) -> tuple[str, int, int, tuple[int, ...]]:
    """Counters added up, and for each slice that has some of two or more a file of what `kept`
    makes of them; the folder, `rows` and `bits`, and the slices with a file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # one that this worker has from a job before
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            out: dict[str, list] = {"slice": [], "once": [], "more": []}
            hashes = np.concatenate(held)
            for row in range(rows):
                cells = np.sort(_cells(hashes, row, bits))
                new = np.append(True, cells[1:] != cells[:-1])
                again = cells[~new]
                more = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
                cells = cells[new]
                borders = np.arange((1 << (bits - slice_bits)) + 1) << slice_bits
                cuts, more_cuts = np.searchsorted(cells, borders), np.searchsorted(more, borders)
                for k in range(len(borders) - 1):
                    if cuts[k] < cuts[k + 1]:
                        out["slice"].append(row << (bits - slice_bits) | k)
                        out["once"].append(_packed(cells[cuts[k] : cuts[k + 1]] - borders[k], 3))
                        out["more"].append(_packed(more[more_cuts[k] : more_cuts[k + 1]] - borders[k], 3))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out["slice"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["more"], pa.binary())],
                names=list(out),
            )

        waiting = 0
        for batch in batches:
            for found in hashes_of(batch):
                if len(found):
                    held.append(found)
                    waiting += len(found)
                if waiting > _HELD:
                    yield send()
                    waiting = 0
        if held:
            yield send()

    folder = new_folder(documents.sparkSession, "sketch")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, more = None, None, None

        def out() -> pa.RecordBatch:
            write_file(folder, f"{now:08d}", TaskContext.get().taskAttemptId(), kept(now, more))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["slice"])

        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if now is not None and more.any():
                        yield out()
                    now, once, more = k, np.zeros(1 << slice_bits, bool), np.zeros(1 << slice_bits, bool)
                touched = _unpacked(a, 3)
                more[touched[once[touched]]] = True
                once[touched] = True
                more[_unpacked(b, 3)] = True
        if now is not None and more.any():
            yield out()

    slices = rows << (bits - slice_bits)
    merged = (
        documents.mapInArrow(count, "slice int, once binary, more binary")
        .repartition(min(slices, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(merge, "slice int")
    )
    return folder, rows, bits, tuple(sorted(row["slice"] for row in merged.collect()))


@lru_cache(maxsize=1)
def _loaded(sketch: Sketch | Filter) -> np.ndarray:
    if isinstance(sketch, Filter):
        slice_bytes = (1 << (sketch.filter_bits - (sketch.bits - sketch.slice_bits))) // 8
        out = np.zeros((1 << sketch.filter_bits) // 8, np.uint8)
        for k in sketch.slices:
            out[k * slice_bytes : (k + 1) * slice_bytes] = np.frombuffer(read_file(sketch.folder, f"{k:08d}"), np.uint8)
        return out
    slice_bytes = (1 << min(sketch.bits, _SLICE_BITS)) // 8
    out = np.zeros((sketch.rows << sketch.bits) // 8, np.uint8)
    for k in sketch.slices:
        out[k * slice_bytes : (k + 1) * slice_bytes] = np.frombuffer(read_file(sketch.folder, f"{k:08d}"), np.uint8)
    return out.reshape(sketch.rows, -1)


def forget() -> None:
    """Give up the sketch that this process has loaded."""
    _loaded.cache_clear()


def maybe_repeated(hashes: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Places of the hashes all whose counters have two or more."""
    cells_of_rows, at = _loaded(sketch), np.arange(len(hashes))
    for row in range(sketch.rows):
        cells = _cells(hashes[at], row, sketch.bits)
        at = at[(cells_of_rows[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1]
    return at


def maybe_in_filter(hashes: np.ndarray, sketch: Filter) -> np.ndarray:
    """Places of the hashes whose counter the filter says has two or more."""
    bits_of, at = _loaded(sketch), np.arange(len(hashes))
    part_bits = sketch.filter_bits - (sketch.bits - sketch.slice_bits)
    cells = _cells(hashes, 0, sketch.bits)
    for row in range(_FILTER_ROWS):
        places = (cells >> sketch.slice_bits << part_bits) | _place(cells, row, part_bits)
        hit = np.flatnonzero((bits_of[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1)
        at, cells = at[hit], cells[hit]
    return at
