"""Byte strings that an earlier document holds too, marked by a run-length compressed index.

Texts are cut into segments by their content: each 50-byte string belongs to the smallest hash among
its 24-byte strings, and the consecutive strings that belong to one such place make a segment, 50 to
76 bytes long. Equal strings thus lie in segments of the same key. A first look at the texts counts
the keys. A second sends the segments whose key may be repeated to buckets by key, each distinct
segment of a task once, with the smallest document that holds it. A bucket keeps each distinct segment
once; what a later document has of it is known to go. Only segments whose key has another segment too
can share strings without being equal. These, in the order of their documents, are indexed by a
run-length compressed Burrows-Wheeler transform; every one is streamed through it, and where the
longest match has 50 bytes or more, the first place with the same 50 bytes tells the smallest document
that holds them. A third look joins what is to go, as bits of segments, to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from fileledger.llm import flat
from fileledger.llm.rows import add_columns, table
from fileledger.llm.run_index import RunIndex
from fileledger.llm.shared_files import new_folder
from fileledger.llm.sketch import Filter, forget, maybe_in_filter, repeated_filter
from fileledger.operators.heavy_keys import join_groups

LENGTH = 50
_KEY_LENGTH = 24
#: Windows of consecutive strings that one place can be the smallest of.
_SPAN = LENGTH - _KEY_LENGTH + 1
#: Bytes of text looked at at once, so that arrays of 64-bit numbers as long stay in a core's cache.
_BLOCK = (1 << 16) - 64
#: Bytes of segments a task keeps before it sends them on.
_HELD = 12 << 20
#: Bytes of segments that are indexed at once, or one more key's; an index of so many stays in a core's cache.
_INDEXED = 1 << 17
#: A key with more bytes of segments is not indexed; its strings are dealt singly.
BUCKET_BYTES = 3 << 20
#: Bytes of input for each bucket, the larger above so many buckets: each flush of a task has a row for
#: every bucket. Segments that may be repeated can be five times the input.
_INPUT_A_BUCKET = (1 << 19, 4 << 20)
_SMALL_BUCKETS = 512
_LAST_ID = 2**63 - 1

_MARKS = "doc_id bigint, segment bigint, strings int"
_OUT = f"{_MARKS}, one bigint, two bigint"


class Segments(NamedTuple):
    """Segments of some texts: bytes `start` to `end` of `data`; the text's number, key and hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    key: np.ndarray
    one: np.ndarray
    two: np.ndarray


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts with their offsets, the first text's number and the first byte's place in it.

    A long text comes in blocks that share `LENGTH` - 1 bytes, so each string lies in one of them.
    """
    if len(offsets) > 2 or len(data) <= _BLOCK:
        yield data, offsets, 0, 0
        return
    for at in range(0, len(data) - LENGTH + 1, _BLOCK):
        part = data[at : at + _BLOCK + LENGTH - 1]
        yield part, np.array([0, len(part)]), 0, at


def segments(data: np.ndarray, offsets: np.ndarray, hashes: int = 2) -> Segments:
    """All segments of texts given behind each other, in order; none, one or both of their hashes."""
    strings = len(data) - LENGTH + 1
    if strings < 1:
        none = np.empty(0, np.int64)
        return Segments(data, none, none, none, *[none.astype(np.uint64)] * 3)
    sums, down = flat.prefix_hashes(data, 7)
    with np.errstate(over="ignore"):
        keys = (sums[_KEY_LENGTH:] - sums[:-_KEY_LENGTH]) * down[: len(sums) - _KEY_LENGTH]
    # The place of the smallest hash of each _SPAN of them, by 16 bits, the first on ties.
    kind, bits = (np.uint32, 16) if len(data) <= 1 << 16 else (np.uint64, 32)
    least = (keys >> np.uint64(48)).astype(kind) << kind(bits) | np.arange(len(keys), dtype=kind)
    width = 1
    while width * 2 <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    place = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])[:strings] & kind((1 << bits) - 1)
    # A segment ends where the next begins, or where strings go over a border.
    new = np.zeros(strings, bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    for cut in (offsets[:-1], np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])):
        new[cut[cut < strings]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], strings) + LENGTH - 1
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = np.flatnonzero(start <= offsets[text + 1] - LENGTH)
    start, end, text = start[inside], end[inside], text[inside]
    keys = flat.mix(keys[place[start]])
    if not hashes:
        return Segments(data, start, end, text, keys, keys[:0], keys[:0])
    size = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = flat.mix((sums[end] - sums[start]) * down[start] + size)
        if hashes == 1:
            return Segments(data, start, end, text, keys, one, keys[:0])
        del sums, down
        sums, down = flat.prefix_hashes(data, 11)
        two = flat.mix((sums[end] - sums[start]) * down[start] + size)
    return Segments(data, start, end, text, keys, one, two >> np.uint64(32))


def _of_batch(batch: pa.RecordBatch, hashes: int = 2) -> Iterator[tuple[Segments, int]]:
    """Segments of a batch's texts, and the number of the row that their first text has."""
    row = 0
    for group in flat.row_groups(batch, most=_BLOCK):
        for data, offsets, _, _ in blocks(*flat.flat(group.column("text"))):
            yield segments(data, offsets, hashes), row
        row += group.num_rows


#: As many bytes as a segment can have.
_WIDE = np.dtype((np.void, LENGTH + _SPAN - 1))


def _wide(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bytes of segments from each place on; a shorter one has others behind it."""
    padded = np.append(data, np.zeros(_WIDE.itemsize, np.uint8))
    return np.ndarray(len(data) + 1, _WIDE, padded, strides=(1,))[start]


def _flat(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of segments of these sizes behind each other."""
    place = np.arange(_WIDE.itemsize, dtype=np.uint8)
    return text.view(np.uint8).reshape(-1, len(place))[place < size.astype(np.uint8)[:, None]]


class _Held(NamedTuple):
    """Segments with a hash of their key, a document that holds each, and their bytes."""

    key: np.ndarray
    one: np.ndarray
    two: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def taken(self, at: np.ndarray) -> _Held:
        return _Held(*(x[at] for x in self))


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by segment, where a segment begins in it, and each entry's segment."""
    order = np.argsort(one)
    new, other = (np.append(True, x[order][1:] != x[order][:-1]) for x in (one, two))
    if (other & ~new).any():
        order = np.lexsort((two, one))
        new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _firsts(parts: list[_Held]) -> tuple[_Held, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct segment once, by key, with its smallest document; and document, segment and size
    of the entries of other documents, which are known to go."""
    held = _Held(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    order, heads, of = _distinct(held.one, held.two)
    doc = held.doc[order]
    least = np.minimum.reduceat(doc, heads)
    later = order[doc > least[of]]
    by_key = np.argsort(held.key[order[heads]])
    first = held.taken(order[heads][by_key])._replace(doc=least[by_key])
    return first, held.doc[later], held.one[later].view(np.int64), held.size[later]


def _batch(names: str, **columns) -> pa.RecordBatch:
    """A batch in the layout of a DDL schema, null where no column is given."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    layout = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(size, kinds[k]) for n, k in layout],
        names=[n for n, _ in layout],
    )


def _all_strings(size: np.ndarray) -> np.ndarray:
    """A bit for each string of segments of the given sizes."""
    return ((1 << (size - LENGTH + 1)) - 1).astype(np.int32)


def known_buckets(segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where rows go that meet nothing: by segment and document, as many documents may hold a segment."""
    spread = flat.mix(segment ^ flat.mix(doc.view(np.uint64)))
    return -1 - (spread >> np.uint64(44)).astype(np.int64)


def bucket_count(n_bytes: int) -> int:
    """How many buckets so many bytes of text are dealt to."""
    small, large = _INPUT_A_BUCKET
    return min(n_bytes // small, max(_SMALL_BUCKETS, n_bytes // large))


_SENT = "bucket bigint, keys binary, one binary, two binary, docs binary, sizes binary, texts binary, doc_id bigint, segment bigint, strings int"


def _marks(documents: DataFrame, sketch: Filter, parts: int, buckets: int, bucket_bytes: int) -> DataFrame:
    """Rows (doc_id, segment, strings): which strings of which segments a document is to lose."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []

        def out() -> Iterator[pa.RecordBatch]:
            first, doc, segment, size = _firsts(held)
            held.clear()
            if len(doc):
                # What is not of the task's smallest document of a segment is known to go.
                bucket = known_buckets(segment.view(np.uint64), doc)
                yield _batch(_SENT, bucket=bucket, doc_id=doc, segment=segment, strings=_all_strings(size))
            # Buckets are ranges of keys, and the segments are in the order of their keys.
            bucket = ((first.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            ends = np.append(0, np.cumsum(first.size))
            texts = _flat(first.text, first.size)
            full, cuts = flat.runs(bucket)
            pieces = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            keys, two, sizes = first.key.astype(np.uint32), first.two.astype(np.uint32), first.size.astype(np.uint8)
            yield _batch(
                _SENT,
                bucket=full,
                keys=[keys[x].tobytes() for x in pieces],
                one=[first.one[x].tobytes() for x in pieces],
                two=[two[x].tobytes() for x in pieces],
                # Small numbers have zeros in their upper bytes, so these go together.
                docs=[first.doc[x].view(np.uint8).reshape(-1, 8).T.tobytes() for x in pieces],
                sizes=[sizes[x].tobytes() for x in pieces],
                texts=[texts[ends[x.start] : ends[x.stop]].tobytes() for x in pieces],
            )

        waiting = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for found, row in _of_batch(batch):
                at = maybe_in_filter(found.key, sketch)
                if len(at):
                    size = found.end[at] - found.start[at]
                    text = _wide(found.data, found.start[at])
                    doc = ids[row + found.text[at]]
                    held.append(_Held(flat.mix(found.key[at]), found.one[at], found.two[at], doc, size, text))
                    waiting += int(size.sum())
                if waiting > _HELD:
                    yield from out()
                    waiting = 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the filter, if this worker has it from the step before
        held: list[_Held] = []
        heavy: set[int] = set()  # keys of the bucket that are dealt singly

        def distinct() -> Iterator[pa.RecordBatch]:
            """What is known to go, and strings of heavy keys; the other segments stay, each once."""
            first, doc, segment, size = _firsts(held)
            if len(doc):
                yield _batch(_OUT, doc_id=doc, segment=segment, strings=_all_strings(size))
            keys, cuts = flat.runs(first.key)
            heavy.update(keys[np.add.reduceat(first.size, cuts[:-1]) > bucket_bytes].tolist())
            if heavy:
                singly = np.isin(first.key, np.array(list(heavy), first.key.dtype))
                if singly.any():
                    yield from _single_strings(first.taken(np.flatnonzero(singly)))
                    first = first.taken(np.flatnonzero(~singly))
            held[:] = [first] if len(first.key) else []

        def out() -> Iterator[pa.RecordBatch]:
            yield from distinct()
            heavy.clear()
            for part in held:
                for at in _with_others(part, min(bucket_bytes, _INDEXED)):
                    yield from _repeated_strings(part.taken(at))
            held.clear()

        now: int | None = None
        waiting, most = 0, 0
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            known = np.flatnonzero(bucket < 0)
            if len(known):
                columns = {n: batch.column(n).take(pa.array(known)) for n in ("doc_id", "segment", "strings")}
                yield _batch(_OUT, **columns)
            for k in np.flatnonzero(bucket >= 0).tolist():
                if bucket[k] != now:
                    if held:
                        yield from out()
                    heavy.clear()
                    now, waiting, most = bucket[k], 0, 4 * bucket_bytes
                key, one, two, docs, sizes, text = (
                    np.frombuffer(batch.column(n)[k].as_buffer(), kind)
                    for n, kind in (
                        ("keys", np.uint32),
                        ("one", np.uint64),
                        ("two", np.uint32),
                        ("docs", np.uint8),
                        ("sizes", np.uint8),
                        ("texts", np.uint8),
                    )
                )
                docs = np.ascontiguousarray(docs.reshape(8, -1).T).view(np.int64)[:, 0]
                sizes = sizes.astype(np.int64)
                held.append(_Held(key, one, two, docs, sizes, _wide(text, np.cumsum(sizes) - sizes)))
                waiting += len(text)
                if waiting > most:
                    yield from distinct()
                    waiting = sum(int(x.size.sum()) for x in held)
                    most = max(4 * bucket_bytes, 2 * waiting)
        if held:
            yield from out()

    found = (
        documents.mapInArrow(send, _SENT).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _OUT)
    )
    # Written down, as strings of large buckets are looked at apart.
    folder = new_folder(documents.sparkSession, "segments")
    found.write.parquet(folder)
    found = documents.sparkSession.read.schema(_OUT).parquet(folder)
    singly = found.filter("one is not null").withColumn("string", F.struct("one", "two"))
    names = ["doc_id", "segment", "strings"]
    marks = found.filter("one is null").select(*names)
    if singly.isEmpty():
        return marks
    firsts = singly.groupBy("string").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    later = join_groups(singly.select("string", *names), firsts, "string", "n", "doc_id").filter("doc_id > first")
    return marks.unionByName(later.select(*names))


def _with_others(held: _Held, most: int) -> Iterator[np.ndarray]:
    """Places of the segments whose key has another segment too, all of a key and some `most` bytes at
    once. A segment alone with its key shares no string with others."""
    _, cuts = flat.runs(held.key)
    count = np.diff(cuts)
    at = np.flatnonzero(np.repeat(count, count) > 1)
    if not len(at):
        return
    count = count[count > 1]
    heads = np.cumsum(count) - count
    size = np.add.reduceat(held.size[at], heads)
    _, parts = flat.runs((np.cumsum(size) - size) // most)
    borders = np.append(heads, len(at))[parts]
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield at[a:b]


def _repeated_strings(held: _Held) -> Iterator[pa.RecordBatch]:
    """Marks of the distinct segments of some keys, from an index of them."""
    held = held.taken(np.argsort(held.doc, kind="stable"))
    sizes = held.size
    text = _flat(held.text, sizes)
    index = RunIndex(text, sizes)
    rows, places = index.blocks(LENGTH)
    length, row, _ = index.matching_statistics(text, sizes)
    # Segments lie in the order of their documents, so a block's first place has the smallest one.
    strings = sizes - LENGTH + 1
    at = flat.ragged(np.cumsum(sizes) - sizes, strings)
    least = np.repeat(held.doc, sizes + 1)[places]  # by block; strings are followed by a separator
    block = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(np.append(rows, len(text) + len(sizes))))
    held_by = np.where(length[at] >= LENGTH, least[block[row[at]]], _LAST_ID)
    before = np.cumsum(strings) - strings
    bit = np.arange(len(at)) - np.repeat(before, strings)
    bits = np.bitwise_or.reduceat(np.where(held_by < np.repeat(held.doc, strings), 1 << bit, 0), before)
    hit = np.flatnonzero(bits)
    if len(hit):
        yield _batch(_OUT, doc_id=held.doc[hit], segment=held.one[hit].view(np.int64), strings=bits[hit].astype(np.int32))


def _single_strings(held: _Held) -> Iterator[pa.RecordBatch]:
    """Every string of the segments as a row of its own, named by 128 bits of hash."""
    _, one, _, doc, size, text = held
    data = _flat(text, size)
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    entry = np.repeat(np.arange(len(size)), strings)
    at = flat.ragged(begin, strings)
    hashes = []
    for seed in (7, 11):
        sums, down = flat.prefix_hashes(data, seed)
        with np.errstate(over="ignore"):
            hashes.append(flat.mix((sums[at + LENGTH] - sums[at]) * down[at]).view(np.int64))
    yield _batch(
        _OUT,
        doc_id=doc[entry],
        segment=one[entry].view(np.int64),
        strings=(1 << (at - begin[entry])).astype(np.int32),
        one=hashes[0],
        two=hashes[1],
    )


def _gone(
    data: np.ndarray, offsets: np.ndarray, text: np.ndarray, segment: np.ndarray, strings: np.ndarray
) -> np.ndarray:
    """Which bytes of texts are to go, given marks: the text's number, a segment of it and its strings."""
    starts = np.zeros(len(data), bool)
    marked = segment.view(np.uint64) ^ flat.mix(text.astype(np.uint64))
    order = np.argsort(marked)
    marked, cuts = flat.runs(marked[order])
    strings = np.bitwise_or.reduceat(strings[order], cuts[:-1])
    for part, part_offsets, _, at in blocks(data, offsets):
        found = segments(part, part_offsets, hashes=1)
        own = found.one ^ flat.mix(found.text.astype(np.uint64))
        place = np.minimum(np.searchsorted(marked, own), len(marked) - 1)
        hit = np.flatnonzero(marked[place] == own)
        bits = np.unpackbits(strings[place[hit]].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        which, k = np.nonzero(bits)
        starts[at + found.start[hit[which]] + k] = True
    return flat.covered(starts, LENGTH, len(data))


def _gone_of_rows(data: np.ndarray, offsets: np.ndarray, marks: pa.ListArray) -> np.ndarray:
    """Which bytes of a batch's texts are to go, looking only at those with marks, some at once."""
    gone = np.zeros(len(data), bool)
    count = pc.list_value_length(marks).fill_null(0).to_numpy(zero_copy_only=False)
    marks, borders = marks.flatten(), np.append(0, np.cumsum(count))
    segment, strings = (marks.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    rows = np.flatnonzero(count)
    ends = np.cumsum(np.diff(offsets)[rows])
    begin = 0
    while begin < len(rows):
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _BLOCK, side="right"))
        some = rows[begin : max(stop, begin + 1)]
        begin += len(some)
        # Rows between them have no marks, so the marks of some rows lie behind each other.
        own = slice(borders[some[0]], borders[some[-1] + 1])
        pieces = [slice(offsets[k], offsets[k + 1]) for k in some.tolist()]
        lengths = np.append(0, np.cumsum([x.stop - x.start for x in pieces]))
        text = np.repeat(np.arange(len(some)), count[some])
        found = _gone(np.concatenate([data[x] for x in pieces]), lengths, text, segment[own], strings[own])
        for x, a, b in zip(pieces, lengths[:-1].tolist(), lengths[1:].tolist(), strict=True):
            gone[x] = found[a:b]
    return gone


def _whole_characters(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Without the bytes of characters of which a byte stays, in texts that begin with a character."""
    if not len(data):
        return gone
    starts = offsets[:-1][np.diff(offsets) > 0]
    first = (data & 0xC0) != 0x80
    broken = starts[~first[starts]]
    first[starts] = True
    heads = np.flatnonzero(first)
    whole = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(data))))
    for start, stop in zip(broken.tolist(), offsets[np.searchsorted(offsets, broken, side="right")].tolist(), strict=True):
        whole[start:stop] = gone[start:stop]
    return whole


def without_repeats(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
    whole_characters: bool = False,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Add `n_bytes`, `n_removed`, `n_spans` and `kept`, the bytes that no earlier document holds.

    A byte goes if a string of 50 bytes over it begins, anywhere, in a document with a smaller id;
    strings are judged on the texts as given, overlaps count, and no string crosses documents.
    `n_spans` counts the stretches removed. With `whole_characters` a character goes only if all its
    bytes do, and `kept` is valid text. Null texts are empty. Rows with equal ids don't remove each
    other's bytes; a null id counts as larger than all others. Other columns stay unless `keep` leaves
    them out; those called like the new ones are replaced.

    Of a segment that many documents hold each task sends the smallest only. A key with over
    `bucket_bytes` of segments, as very many different surroundings make it, is not indexed: its
    strings are dealt singly by their hashes, which joins of any group size can do.
    """
    spark = documents.sparkSession
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST_ID))
    source = documents.select(key.alias("doc_id"), F.col(text).alias("text"))
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = repeated_filter(
        source, lambda batch: (x.key for x, _ in _of_batch(batch, hashes=0)), n_bytes // (_SPAN // 2)
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = _marks(source, sketch, parts, max(parts, bucket_count(n_bytes)), bucket_bytes)
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("segment", "strings")).alias("__marks"))
    joined = documents.withColumn("__id", key).join(marks, "__id", "left")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = flat.flat(batch.column(text))
        gone = _gone_of_rows(data, offsets, batch.column("__marks"))
        if whole_characters:
            gone = _whole_characters(data, offsets, gone)
        sizes = np.diff(offsets)
        new = gone & ~np.append(False, gone[:-1])[: len(gone)]
        full = np.flatnonzero(sizes)
        starts = offsets[full]
        new[starts] = gone[starts]
        removed, spans = np.zeros((2, len(sizes)), np.int64)
        if len(full):
            removed[full], spans[full] = (np.add.reduceat(x, starts, dtype=np.int64) for x in (gone, new))
        ends = np.append(0, np.cumsum(sizes - removed)).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
        return [*(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), kept]

    fields = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("__id", "__marks")]
    return add_columns(joined, [*fields, StructField("kept", BinaryType())], cut, text, kept, uses=["__marks"])


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes every document loses to earlier ones, in how many stretches, and a digest of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL, on two hexadecimal digits a byte.
SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
    octet_length(encode(coalesce(text, '')))::BIGINT AS n
  FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS key
  FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM bytes WHERE n >= 50)
), firsts AS (SELECT key, min(doc_id) AS first FROM strings GROUP BY key),
gone AS (SELECT doc_id, i FROM strings JOIN firsts USING (key) WHERE doc_id > first),
marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
  FROM gone
), numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 49 AS b FROM numbered GROUP BY doc_id, span
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS front
  FROM cuts JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""
