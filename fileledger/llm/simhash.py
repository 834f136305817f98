"""SimHash fingerprints, and groups of texts whose fingerprints differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from fileledger.llm import flat
from fileledger.llm.components import components
from fileledger.llm.rows import add_columns, table
from fileledger.operators.heavy_keys import join_groups
from fileledger.session import cut_lineage

SHINGLE_WORDS = 3
MOST_BITS = 3
_SEED = 42
_SHINGLES_AT_ONCE = 1 << 16
#: Buckets with more fingerprints are dealt anew by finer blocks.
BUCKET = 4096


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is set in over half the hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: letters A to Z and white space of ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    shingles = max(1, len(words) - size + 1)
    starts, ends = starts[:shingles].tolist(), ends[-shingles:].tolist()
    set_bits = np.zeros(64, np.int64)
    for at in range(0, shingles, _SHINGLES_AT_ONCE):
        part = range(at, min(shingles, at + _SHINGLES_AT_ONCE))
        hashes = np.fromiter(
            map(xxh64_intdigest, [line[starts[i] : ends[i]] for i in part], repeat(_SEED)), "<u8", len(part)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > shingles, bitorder="little").view("<u8")[0])


def fingerprints(
    documents: DataFrame, size: int = SHINGLE_WORDS, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add `fingerprint`, a 64-bit SimHash of each whole text, however long.

    A text without words, empty or null, has fingerprint 0.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).cast(pa.binary()).fill_null(b"").to_pylist()
        return [pa.array(np.array([fingerprint(x, size) for x in texts], np.uint64).view(np.int64))]

    return add_columns(documents, [StructField("fingerprint", LongType())], compute, text, keep)


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks of all sets of `blocks - bits` of as many blocks: values that differ in at most `bits`
    places agree on one of them at least."""
    borders = [64 * k // blocks for k in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(borders, borders[1:])]
    return [sum(x) for x in combinations(single, blocks - bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bucket_links(values: np.ndarray, ids: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within `bits` bits in one bucket, at most one for each value."""
    root, pattern = np.arange(len(values)), values.view(np.uint64)
    last = np.append(np.flatnonzero(np.diff(bucket)), len(bucket) - 1)
    left = last[np.searchsorted(last, root)] - root  # values behind it in its bucket
    at, lag = np.flatnonzero(left > 0), 1
    while len(at):
        near = at[np.bitwise_count(pattern[at] ^ pattern[at + lag]) <= bits]
        while True:
            one, two = root[near], root[near + lag]
            apart = one != two
            if not apart.any():
                break
            root[np.maximum(one, two)[apart]] = np.minimum(one, two)[apart]
            while (root[root] != root).any():
                root = root[root]
        lag += 1
        at = at[left[at] >= lag]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return ids[linked], ids[root[linked]]


def _links_in_buckets(values: DataFrame, bits: int, blocks: int, most: int | None) -> DataFrame:
    """Rows (a, b): links; with b null, values of buckets with over `most` of them."""
    # One row for each mask; as a loop over an array, so that the code stays small.
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(bits, blocks)])
    keys = F.transform(masks, lambda m, k: F.struct(k.alias("k"), F.col("value").bitwiseAND(m).alias("key")))

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other], names=["a", "b"])

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets; the large ones' values."""
        if len(rows) < 2:
            return
        bucket = np.cumsum(np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        if most is not None:
            large = np.bincount(bucket)[bucket] > most
            if large.any():
                yield out(rows[large, 3], None)
                rows, bucket = rows[~large], bucket[~large]
        if len(rows) > 1:
            yield out(*_bucket_links(rows[:, 2].copy(), rows[:, 3], bucket, bits))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)  # the bucket that may go on
        over = None  # the key of a bucket that has grown too large
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            if over is not None:
                same = (rows[:, :2] == over).all(axis=1)
                if same.any():
                    yield out(rows[same, 3], None)
                    rows = rows[~same]
                if not len(rows):
                    continue
                over = None
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            of_last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            tail = len(rows) - int(of_last.sum())  # rows are sorted, so these are the last ones
            yield from settle(rows[:tail])
            held = rows[tail:]
            if most is not None and len(held) > most:
                yield out(held[:, 3], None)
                over, held = held[0, :2].copy(), held[:0]
        yield from settle(held)

    return (
        values.select("id", "value", F.explode(keys).alias("x"))
        .select("x.k", "x.key", "value", "id")
        .repartition("k", "key")
        .sortWithinPartitions("k", "key", "value", "id")
        .mapInArrow(link, "a bigint, b bigint")
    )


def near_values(values: DataFrame, bits: int = MOST_BITS, blocks: int = 5, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between ids, by which all rows reach each other that chains of near values join.

    `values` has `id` and `value`, 64 bits, no value twice; values are near if they differ in at most
    `bits` bits. Each value goes to one bucket for every choice of `blocks` - `bits` blocks; two values
    at most `bits` bits apart share one at least. With 5 blocks a bucket is named by 25 bits. A bucket
    of more than `bucket` values is not compared: its values are dealt again by 16 blocks, where 52
    bits name a bucket, so that it can't hold more than 4096 different ones. In a bucket every pair is
    looked at by one task, but only links that join parts not joined yet are given out, less than the
    bucket has values.
    """
    first = cut_lineage(_links_in_buckets(values, bits, blocks, bucket))
    again = first.filter("b is null").select(F.col("a").alias("id")).distinct()
    links = first.filter("b is not null")
    if not again.isEmpty():
        large = cut_lineage(values.join(again, "id", "left_semi"))
        links = links.unionByName(_links_in_buckets(large, bits, 16, None))
    return links


def near_groups(fingerprinted: DataFrame, bits: int = MOST_BITS, doc_id: str = "doc_id") -> DataFrame:
    """Add `component_id`: the smallest id reachable over fingerprints at most `bits` bits apart.

    Takes `fingerprint` and a few columns a row, not texts. Rows with equal fingerprints are one row,
    named by its smallest id, from the first shuffle on, so a group of exact copies of any size is a
    single row; only at the end rows meet their component, those of large groups in slices. Rows
    without fingerprint or without id have a null component. Repeated rows stay; rows of one id are
    taken for one document.
    """
    rows = cut_lineage(fingerprinted)
    whole = rows.filter(F.col(doc_id).isNotNull() & F.col("fingerprint").isNotNull())
    values = cut_lineage(
        whole.groupBy("fingerprint").agg(F.min(doc_id).alias("id"), F.count("*").alias("__n"))
    )
    links = near_values(values.select("id", F.col("fingerprint").alias("value")), bits)
    found = cut_lineage(components(links))
    named = values.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "fingerprint", "__n", F.coalesce("root", "id").alias("component_id")
    )
    joined = join_groups(rows.drop("component_id"), named, "fingerprint", "__n", doc_id, how="left")
    has_id = F.col(doc_id).isNotNull()
    return joined.withColumn("component_id", F.when(has_id, F.col("component_id"))).drop("__n")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the first document of its near-duplicate group."""
    marked = fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return near_groups(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
