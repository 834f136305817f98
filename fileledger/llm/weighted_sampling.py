"""Document fingerprints by consistent weighted sampling.

Each of a fingerprint's samples draws one weighted term: for term x of weight w, with r and c from
Gamma(2, 1) and b uniform, all fixed by (x, sample), t = floor(ln w / r + b), y = exp(r (t - b)) and
a = c / (y e^r); the term with the smallest a is drawn, together with t. Two documents draw the same
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima of
the weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField
from pyspark.sql.window import Window

from fileledger.llm import flat
from fileledger.llm.pieces import clean_texts
from fileledger.llm.rows import add_columns, table
from fileledger.session import cut_lineage

SAMPLES = 64
#: Bytes of text a task works on at once: the more, the fewer terms are drawn for again.
GROUP_BYTES = 8 << 20
_TERMS_AT_ONCE = 1 << 11
_PAIRS_AT_ONCE = 1 << 12
#: Sample of a text without terms; a drawn one is never this.
_NOTHING = 0xFFFF


def _uniform(values: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper bits of hashes."""
    return ((values >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each (term, weight) and sample, the value to be least: 32 bits of a, then of what is drawn."""
    with np.errstate(over="ignore"):
        seeds = flat.mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # One 64-bit hash gives two numbers of 24 bits, from both its ends.
        first = flat.mix(terms[:, None] ^ seeds)
        second = flat.mix(first + np.uint64(0xD1B54A32D192ED03))
        third = flat.mix(second + np.uint64(0x8CB92BA72F3D8DD7))
    low = np.uint64(24)
    r = -np.log(_uniform(first) * _uniform(first << low))
    log_c = np.log(-np.log(_uniform(second) * _uniform(second << low)))
    b = _uniform(third)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    log_a = log_c - r * (t - b) - r
    # Floats as integers of the same order.
    raw = log_a.view(np.int32).astype(np.int64)
    order = np.where(raw >= 0, raw + (1 << 31), ~raw).astype(np.uint64)
    drawn = flat.mix(terms[:, None] + t.astype(np.int64).view(np.uint64)) >> np.uint64(32)
    return order << np.uint64(32) | drawn


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text; its terms are the words, weighted by how often they occur."""
    offsets = np.append(0, np.cumsum([len(x) for x in texts], dtype=np.int64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = flat.spans(data, offsets, flat.WORD_BYTES)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    words = flat.span_hashes(data, starts, ends)
    order = np.lexsort((words, doc))
    doc, words = doc[order], words[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (words[1:] != words[:-1]))) if len(doc) else doc
    weights = np.diff(np.append(heads, len(doc)))
    doc, words = doc[heads], words[heads]
    best = np.full((len(texts), samples), np.iinfo(np.uint64).max, np.uint64)
    # Equal terms of equal weight draw alike, so each of them is drawn for once. They are worked on in
    # ascending order, in blocks, and each document keeps the least it has seen.
    by_term = np.lexsort((weights, words))
    doc, words, weights = doc[by_term], words[by_term], weights[by_term]
    new = np.append(True, (words[1:] != words[:-1]) | (weights[1:] != weights[:-1])) if len(doc) else doc
    term = np.cumsum(new) - 1
    at = 0
    while at < len(doc):
        stop = int(np.searchsorted(term, term[at] + _TERMS_AT_ONCE))
        block = slice(at, stop)
        chosen = np.flatnonzero(new[block]) + at
        draws = _draws(words[chosen], weights[chosen], samples)
        own = term[block] - term[at]
        by_doc = np.argsort(doc[block], kind="stable")
        of, own = doc[block][by_doc], own[by_doc]
        for low in range(0, len(of), _PAIRS_AT_ONCE):
            part = of[low : low + _PAIRS_AT_ONCE]
            runs = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            least = np.minimum.reduceat(draws[own[low : low + _PAIRS_AT_ONCE]], runs, axis=0)
            best[part[runs]] = np.minimum(best[part[runs]], least)
        at = stop
    found = (best & np.uint64(0xFFFFFFFF)) % np.uint64(_NOTHING)
    found[best[:, 0] == np.iinfo(np.uint64).max] = _NOTHING
    return found.astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of the generalised Jaccard similarity."""
    return (one == other).mean(axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    raw, size = rows.astype(">u2").tobytes(), rows.shape[1] * 2
    return pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())


def weighted_fingerprints(
    documents: DataFrame, samples: int = SAMPLES, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add `fingerprint`, four hexadecimal digits per sample.

    Equal texts have equal fingerprints. Terms are words, whatever lies between white space. Texts
    without words, null ones too, have the same fingerprint, of `f` only, like each other and no
    other. Rows stay where they are.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_binary(signatures(clean_texts(batch.column(text)), samples))]

    found = add_columns(documents, [StructField("fingerprint", BinaryType())], compute, text, keep)
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def edited(text: bytes, following: bytes) -> bytes:
    """`text` with its last half replaced by as many characters from the start of another text."""
    own, other = text.decode(), following.decode()
    half = len(own) // 2
    return (own[: len(own) - half] + other[:half]).encode()


# Fingerprints and digests stay binary until the end: half the bytes to write down.
_FOUND = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.binary(),
    "fingerprint": pa.binary(),
    "edited_fingerprint": pa.binary(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_ENDS = {"part": pa.int32(), "head": pa.binary(), "tail": pa.binary()}
_FOUND_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary,"
    " near_edited double, near_next double"
)


def _batch(kinds: dict[str, pa.DataType], rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch with the given columns, and nulls in the others."""
    return pa.RecordBatch.from_arrays(
        [columns.get(name, pa.nulls(rows, kind)) for name, kind in kinds.items()], names=list(kinds)
    )


def _compared(ids: list, texts: list[bytes], following: bytes, samples: int) -> dict[str, pa.Array]:
    """Columns of consecutive documents; `following` comes after the last."""
    changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
    found = signatures([*texts, following, *changed], samples)
    own, behind, of_changed = found[: len(texts)], found[1 : len(texts) + 1], found[len(texts) + 1 :]
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(x.decode()) for x in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x).digest() for x in changed], pa.binary()),
        "fingerprint": _binary(own),
        "edited_fingerprint": _binary(of_changed),
        "near_edited": pa.array(likeness(own, of_changed), pa.float64()),
        "near_next": pa.array(likeness(own, behind), pa.float64()),
    }


def neighbour_likeness(
    documents: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document.

    The next document is the one with the next larger id, after the last the first; the edited text
    ends with the start of it. Texts are shuffled once, by ranges of ids, and a task compares the
    consecutive documents of its range. The last document of each range is compared afterwards, with
    the first of the next range: a task writes these two texts down with its results. Null texts are
    empty. Rows with equal ids follow each other in the order of their texts' hashes; rows without id
    come first. Other columns are not read. A table of one row has itself as next.
    """
    place = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = _FOUND | _ENDS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids, texts = None, [], []
        for whole in batches:
            for batch in flat.row_groups(whole, most=GROUP_BYTES):
                new = clean_texts(batch.column("text"))
                head = new[0] if head is None else head
                # The last document of the group before is still waiting for its next.
                ids, texts = ids + batch.column("doc_id").to_pylist(), texts + new
                if len(ids) > 1:
                    yield _batch(kinds, len(ids) - 1, **_compared(ids[:-1], texts[:-1], texts[-1], samples))
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield _batch(
                kinds,
                1,
                doc_id=pa.array(ids, pa.int64()),
                part=pa.array([TaskContext.get().partitionId()], pa.int32()),
                head=pa.array([head], pa.binary()),
                tail=pa.array(texts, pa.binary()),
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(_FOUND, 1, **_compared([row["doc_id"]], [row["tail"]], row["following"], samples))

    ranges = cut_lineage(
        source.repartitionByRange(*place[:2])
        .sortWithinPartitions(*place)
        .mapInArrow(compare, f"{_FOUND_DDL}, part int, head binary, tail binary")
    )
    ends = ranges.filter("part is not null")
    in_order = Window.orderBy("part")  # one row per task, without its texts
    turns = ends.select("part", F.lead("part").over(in_order).alias("next"), F.first("part").over(in_order).alias("top"))
    turns = turns.select("part", F.coalesce("next", "top").alias("next"))
    pairs = (
        ends.join(turns, "part")
        .join(ends.select(F.col("part").alias("next"), F.col("head").alias("following")), "next")
        .select("doc_id", "tail", "following")
    )
    found = ranges.filter("part is null").drop(*_ENDS).unionByName(pairs.mapInArrow(meet, _FOUND_DDL))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like it the next document is."""
    return neighbour_likeness(table(spark, sf_dir, "documents"))
