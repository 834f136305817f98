"""Whitening of embeddings: coordinates of unit variance and no correlation.

The rows of the fit list are centred and reduced block by block to one triangular matrix R; tasks reduce
their blocks, and the triangles are reduced in rounds. R, as large as an embedding is long, squared, is
made bidiagonal and solved (`bidiagonal`); its right singular vectors are the directions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm.bidiagonal import right_singular
from fileledger.llm.rows import table
from fileledger.session import cut_lineage

COMPONENTS = 16
_SCALE, _SHIFT = 64, 1_000_000
_MOST = 2.0**62
#: How many tasks' results are merged by one task of a round.
_FAN = 16
_ROWS_AT_ONCE = 1 << 12
_WIDTHS = [np.dtype(f"<i{w}") for w in (1, 2, 4, 8)]


def whole_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `length` entries, all of them finite, and these as whole numbers less the shift."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    place = np.flatnonzero(sizes == length)
    if not len(place) or not length:
        return np.zeros(len(column), bool), np.empty((0, length), np.int64)
    entries = column.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    finite = np.isfinite(entries).all(axis=1)  # nulls have become NaN
    good = np.zeros(len(column), bool)
    good[place[finite]] = True
    return good, np.clip(np.floor(_SCALE * entries[finite]), -_MOST, _MOST).astype(np.int64)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector in as few bytes an entry as it needs, behind a byte that tells how many."""
    low, high = vectors.min(axis=1), vectors.max(axis=1)
    need = sum(((low < np.iinfo(w).min) | (high > np.iinfo(w).max)).astype(int) for w in _WIDTHS[:-1])
    out = [b""] * len(vectors)
    for k in np.unique(need):
        rows = np.flatnonzero(need == k)
        raw, size = vectors[rows].astype(_WIDTHS[k]).tobytes(), vectors.shape[1] * _WIDTHS[k].itemsize
        for i, row in enumerate(rows.tolist()):
            out[row] = bytes([k]) + raw[i * size : (i + 1) * size]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            packed = batch.column(0).slice(at, _ROWS_AT_ONCE).to_pylist()
            yield np.stack([np.frombuffer(x, _WIDTHS[x[0]], length, 1).astype(np.int64) for x in packed])


def _reduced(fit: DataFrame, length: int, start: Callable[[Iterator[np.ndarray]], Any], merge: Callable) -> Any:
    """What `start` makes of each task's blocks, merged pair by pair in rounds; None without rows.

    Of each state only `_FAN` pass through one task; every round is written down.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches, length)
        first = next(blocks, None)
        if first is not None:
            state = start(x for part in ([first], blocks) for x in part)
            yield _state(TaskContext.get().partitionId(), state)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                other = pickle.loads(row["state"])
                if part is not None and part != row["part"]:
                    yield _state(part, state)
                    state = None
                part, state = row["part"], other if state is None else merge(state, other)
        if part is not None:
            yield _state(part, state)

    states = cut_lineage(fit.select("x").mapInArrow(begin, "part bigint, state binary"))
    last = states.agg(F.max("part")).first()[0]
    while last:
        states = states.withColumn("part", F.floor(F.col("part") / _FAN)).repartition("part")
        states = cut_lineage(states.sortWithinPartitions("part").mapInArrow(fold, "part bigint, state binary"))
        last //= _FAN
    found = states.select("state").first()
    return None if found is None else pickle.loads(found[0])


def _state(part: int, state: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "state": [pickle.dumps(state)]})


def _sums(blocks: Iterator[np.ndarray]) -> tuple[int, list[int]]:
    """How many vectors, and their sums, as numbers of any size."""
    rows, total = 0, None
    for x in blocks:
        wide = x if abs(x).max(initial=0) < 1 << 40 else x.astype(object)
        own = [int(v) for v in wide.sum(axis=0)]
        rows, total = rows + len(x), own if total is None else [a + b for a, b in zip(total, own)]
    return rows, total


def _centred(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    """x - sums / rows; the difference is taken in whole numbers, so nothing cancels."""
    return (_scaled(x, rows, sums) / rows).astype(float)


def _scaled(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    """rows * x - sums, exact; as Python's numbers where 64 bits don't do."""
    fits = rows * int(abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums)) < 1 << 61
    return rows * x - np.array(sums, np.int64) if fits else rows * x.astype(object) - np.array(sums, object)


def _deviations(scaled: np.ndarray) -> list[int | None]:
    """The exact sums of squares; None where 64 bits don't do."""
    if scaled.dtype != object and float(abs(scaled).max(initial=0)) ** 2 * scaled.shape[1] < 2.0**62:
        return (scaled * scaled).sum(axis=1).tolist()
    exact = (scaled.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _triangle(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """R of both on top of each other."""
    return np.linalg.qr(np.concatenate([above, below]), mode="r")


def _moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = y.mean(axis=0)
    return len(y), mean, (y - mean).T @ (y - mean)


def _joined(one: tuple, other: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred products of two parts together."""
    rows, step = one[0] + other[0], other[1] - one[1]
    mean = one[1] + step * (other[0] / rows)
    return rows, mean, one[2] + other[2] + np.outer(step, step) * (one[0] * other[0] / rows)


class Whitening:
    """A fitted whitening: `directions` has a column for each component, scaled to unit variance."""

    def __init__(self, rows: int, sums: list[int], directions: np.ndarray, explained: np.ndarray) -> None:
        self.rows, self.sums, self.directions, self.explained = rows, sums, directions, explained
        self.identity_error = float("nan")


def fit_whitening(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ones of `vectors`, a table of packed vectors `x`; None without any.

    Components without variance, as where there are fewer vectors than entries, are left out.
    """
    fit = cut_lineage(vectors.select("x").distinct())
    found = _reduced(fit, length, _sums, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]))
    if found is None:
        return None
    rows, sums = found

    def reduce_blocks(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.empty((0, length))
        for x in blocks:
            r = _triangle(r, _centred(x, rows, sums))
        return r

    r = _reduced(fit, length, reduce_blocks, _triangle)
    square = np.zeros((length, length))
    square[: len(r)] = r
    values, right = right_singular(square)
    kept = int((values > values[0] * (length * np.finfo(float).eps) ** 2).sum()) if values[0] > 0 else 0
    kept = min(kept, rows - 1, components)
    # Either sign would do; the largest entry is made positive.
    right = right[:, :kept]
    right = right * np.where(np.take_along_axis(right, abs(right).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    eigenvalues = values[:kept] / rows
    fitted = Whitening(rows, sums, right / np.sqrt(eigenvalues), values[:kept] / values.sum() if kept else eigenvalues)

    def measure(blocks: Iterator[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        state = None
        for x in blocks:
            own = _moments(_centred(x, rows, sums) @ fitted.directions)
            state = own if state is None else _joined(state, own)
        return state

    if kept:
        _, _, products = _reduced(fit, length, measure, _joined)
        fitted.identity_error = float(abs(products / rows - np.eye(kept)).max())
    return fitted


def whitened_embeddings(
    embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """A row for each vector and component, the components with the most variance first.

    Entries become whole numbers, floor(64 c) + 1000000. The whitening is fitted to the distinct
    vectors; all rows are whitened, repeated ones too. Rows whose vector is null or holds a null or an
    entry that is not finite are left out, and so are those of another length than most vectors have
    (of equally many the longer). Entries beyond 2^56 count as that. `deviation` is null where it
    takes more than 64 bits. Components without variance have no rows, so a table with a single
    distinct vector has none. Ids may be null or repeated; other columns are not read.
    """
    given = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    sizes = given.filter("vector is not null").groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    length = usual["size"] if usual else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                _, x = whole_vectors(batch.column(0).slice(at, _ROWS_AT_ONCE), length)
                if len(x):
                    yield pa.RecordBatch.from_pydict({"x": pa.array(_packed(x), pa.binary())})

    fitted = fit_whitening(given.select("vector").mapInArrow(pack, "x binary"), length, components) if length else None
    kept = len(fitted.explained) if fitted else 0

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if kept else ():
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                own = batch.slice(at, _ROWS_AT_ONCE)
                good, x = whole_vectors(own.column(1), length)
                scaled = _scaled(x, fitted.rows, fitted.sums)
                y = (scaled / fitted.rows).astype(float) @ fitted.directions
                ids = own.column(0).filter(pa.array(good))
                turn = np.repeat(np.arange(len(x)), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(turn)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(turn), fitted.rows, np.int64)),
                        pa.array(_deviations(scaled), pa.int64()).take(pa.array(turn)),
                        pa.array(y.reshape(-1)),
                        pa.array(np.tile(fitted.explained, len(x))),
                        pa.array(np.full(len(turn), fitted.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = given.schema["vec_id"].dataType.simpleString()
    return given.mapInArrow(
        whiten,
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened coordinates of every embedding."""
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))
