"""Search in metadata by an index of trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions import metadata
from fileledger.operators.membership import NAMED, among
from fileledger.operators.reports import search_metadata
from fileledger.session import cut_lineage

POSTINGS = "trigram int, file_id bigint"
#: A keyword is looked up by so many of its trigrams, the rarest.
LOOKED_UP = 4
#: Postings of a trigram are spread by ranges of 2^20 ids.
_RANGE_BITS = 20
_BYTES_AT_ONCE = 4 << 20


def _codes(data: np.ndarray) -> np.ndarray:
    """Each three bytes in a row as one number."""
    wide = data.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, file_id) of batches (file_id, value), each once for the values that are looked at together."""
    for batch in batches:
        values = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        ids, start = batch.column(0).to_numpy(), 0
        first = np.maximum.accumulate(np.where(np.append(True, ids[1:] != ids[:-1]), np.arange(len(ids)), 0)) if len(ids) else ids
        while start < len(values):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _BYTES_AT_ONCE, "right")) - 1)
            stop = min(stop, len(values))
            low, high = int(offsets[start]), int(offsets[stop])
            if high - low >= 3:
                codes = _codes(np.frombuffer(values.buffers()[2], np.uint8)[low:high])
                value = np.repeat(np.arange(start, stop), np.diff(offsets[start : stop + 1]))
                inside = value[:-2] == value[2:]
                # A file's values follow each other.
                found = np.unique(first[value[:-2][inside]] << 24 | codes[inside])
                ids = batch.column(0).take(pa.array(found >> 24))
                yield pa.RecordBatch.from_arrays([pa.array((found & 0xFFFFFF).astype(np.int32)), ids], ["trigram", "file_id"])
            start = stop


def trigrams(inventory: DataFrame) -> DataFrame:
    """(trigram, file_id): the trigrams, of bytes, in the string values of each file's metadata.

    Values are found by Spark's functions and cut into trigrams a few MB at a time. A trigram may come
    again for a file with very many or long values. Rows without metadata or id have none.
    """
    values = inventory.filter("file_id is not null").select(
        "file_id", F.explode(metadata.string_values(F.col("metadata"))).alias("value")
    )
    return values.filter("octet_length(value) > 2").mapInArrow(_post, POSTINGS)


def write_postings(inventory: DataFrame, path: str, mode: str = "error") -> None:
    """Write the trigrams, sorted in each file of the table, so that a look at one reads few pages.

    For files added later append their postings; those of files that are gone do no harm. A trigram
    of very many files is spread by ranges of ids.
    """
    spread = trigrams(inventory).repartition("trigram", F.shiftright("file_id", _RANGE_BITS))
    spread.sortWithinPartitions("trigram", "file_id").write.mode(mode).parquet(path)


def needed_trigrams(keyword: str) -> list[int]:
    """The trigrams that any value like the keyword holds; none if its pieces are too short."""
    raw = [np.frombuffer(piece.encode(), np.uint8) for piece in metadata.literal_pieces(keyword)]
    return sorted({int(code) for piece in raw if len(piece) > 2 for code in _codes(piece)})


def candidates(postings: DataFrame, keyword: str, looked_up: int = LOOKED_UP) -> DataFrame | None:
    """(file_id) of the files that hold the keyword's rarest trigrams; None if it has none."""
    needed = needed_trigrams(keyword)
    if not needed:
        return None
    of_keyword = postings.filter(F.col("trigram").isin(needed))
    # At most one row for each trigram of the keyword.
    counts = {r["trigram"]: r["count"] for r in of_keyword.groupBy("trigram").count().collect()}
    rarest = sorted(needed, key=lambda t: counts.get(t, 0))[:looked_up]
    place = F.array_position(F.array(*map(F.lit, rarest)), F.col("trigram")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1), place)
    held = postings.filter(F.col("trigram").isin(rarest)).groupBy("file_id").agg(F.bit_or(bit).alias("held"))
    return held.filter(F.col("held") == (1 << len(rarest)) - 1).select("file_id")


def search_with_postings(
    inventory: DataFrame, postings: DataFrame, keyword: str, named: int = NAMED, looked_up: int = LOOKED_UP
) -> DataFrame:
    """The same rows as `search_metadata`, looking at the documents of candidates only.

    Postings name the files that hold the rarest trigrams of the keyword; those few are tested by
    their documents. The scan of the inventory is told their ids (`among`); up to `named` of them let it skip
    row groups and pages, where the inventory lies in the order of ids. Keywords without three bytes in a row between wildcards are searched the plain way.
    """
    found = candidates(postings, keyword, looked_up)
    if found is None:
        return search_metadata(inventory, keyword)
    found = cut_lineage(found)
    files = among(inventory, "file_id", found, named).join(found, "file_id", "left_semi")
    return search_metadata(files, keyword)
