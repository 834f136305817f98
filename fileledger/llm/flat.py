"""Texts of an Arrow batch as flat byte arrays: words, hashes of spans, ragged gathers.

A batch is worked on in groups of rows of a few MB, so temporary arrays stay small whatever the
batch size; a text larger than that makes a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GROUP_BYTES = 4 << 20
#: Bytes hashed at once, so that the tables of powers stay small.
_BLOCK = (1 << 18) - 64

#: Bytes of words: everything but space and U+0009 to U+000D.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, 9, 10, 11, 12, 13]] = False


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other as bytes, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_groups(batch: pa.RecordBatch, column: str = "text", most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text, or one row."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in the 256-entry table `inside`.

    No run crosses a text border. The third array has the number of runs before each text, and
    their total at the end.
    """
    here = np.zeros(len(data) + 2, bool)
    here[1:-1] = inside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before, after = here[:-1], here[1:]
    starts = np.flatnonzero(after & (~before | border))
    ends = np.flatnonzero(before & (~after | border))
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    base = int(np.random.default_rng(seed + 1).integers(2**61, 2**62)) * 2 + 1
    with np.errstate(over="ignore"):
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def prefix_hashes(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, and the factors that take a span's place out.

    The hash of bytes i to j is (sums[j] - sums[i]) * factors[i].
    """
    up, down = _powers(seed, 1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_values(seed)[data] * up[: len(data)], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, side="right")))
        sums, down = prefix_hashes(data[first : ends[stop - 1]], seed)
        a, b = starts[at:stop] - first, ends[at:stop] - first
        with np.errstate(over="ignore"):
            part = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        out[at:stop] = mix(part)
        at = stop
    return out


def window_hashes(values: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive values, in order."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    count = len(values) - size + 1
    factors = _byte_values(seed + 100)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += values[k : k + count] * factors[k % 256]
            if k % 256 == 255:
                out = mix(out)
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1 ... of each run, one run behind the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs of equal ones, and where each run begins and the last ends."""
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))[: len(values)]
    return values[heads], np.append(heads, len(values))


def covered(marks: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `length` places lie in a run of `size` that begins at a marked one."""
    depth = np.zeros(len(marks) + size, np.int32)
    depth[: len(marks)] += marks
    depth[size:] -= marks
    return (np.cumsum(depth[:-1]) > 0)[:length]
