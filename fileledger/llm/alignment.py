"""Links between the tokens of two tokenizers, counted by bitmaps of documents.

Both tokenizers cut the same bytes, so tokens that overlap are linked. Postings tell in which documents
a pair of token ids is linked: documents are numbered in chunks, and of a pair and a chunk there is a
compressed bitmap for each binary digit of how often it is linked in a document. All planes OR-ed and
counted give the number of documents, the planes counted with their weights the number of links. The
numbers then go back to the documents along the same postings, so no text is encoded twice.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm import flat
from fileledger.llm.rows import table
from fileledger.llm.shared_files import new_folder
from fileledger.operators.heavy_keys import join_groups
from fileledger.session import cut_lineage

#: Documents of a chunk; a bitmap has as many bits, and is kept as 16-bit numbers while these are fewer bytes.
CHUNK = 1 << 13
_BITMAP_BYTES = CHUNK // 8
#: Postings a task holds before it gives them out. A chunk may go on; its bitmaps are OR-ed later.
POSTINGS = 1 << 21
_GROUP_BYTES = 1 << 20
_ID_BITS = 20
_DOCUMENT = "doc_id bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha256 binary"
_ALIGNED = f"chunk bigint, pair bigint, plane int, bitmap binary, {_DOCUMENT}"
_KINDS = {
    "chunk": pa.int64(), "pair": pa.int64(), "plane": pa.int32(), "bitmap": pa.binary(), "doc_id": pa.int64(),
    "place": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "sha256": pa.binary(),
}


# Fixed value: how byte-level tokenizers of the first kind cut a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters beyond the Latin alphabets, of which Unicode's versions say different things.
_NEWER = re.compile("[^\x00-\u024f]")


class _Strings:
    """Byte strings behind each other, to be gathered by number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[flat.ragged(self.starts[numbers], self.lengths[numbers])]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, as a byte again.

    Printable bytes stand for themselves; the others, in order, are the letters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Ids of texts by both tokenizers, and the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_level)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        names = {i: t for t, i in self._a.get_vocab(with_added_tokens=False).items()}
        self.a = _Strings([bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)])
        self.b = _Strings([self._piece(i) for i in range(self._b.get_piece_size())])
        most = max(len(self.a.lengths), len(self.b.lengths))
        if most > 1 << _ID_BITS:
            raise ValueError(f"ids take more than {_ID_BITS} bits")
        self.decimals = _Strings([str(i).encode() for i in range(most)])
        self._plain = self._by_rank(byte_level)

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def _by_rank(self, byte_level: str) -> Callable[[str], list[int]] | None:
        """The first tokenizer as an encoder by ranks, three times as fast; None if it isn't one.

        It is one if ids count the bytes and then the merges, in their order. Both libraries then merge
        alike; they may only differ in what they take for a letter in newer alphabets.
        """
        import tiktoken

        with open(byte_level, encoding="utf-8") as file:
            whole = json.load(file)
        vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        own = whole["pre_tokenizer"] or {}
        if whole["normalizer"] or any(own.get(k) != v for k, v in usual.items()):
            return None
        if [vocabulary.get(m) for m in joined] != list(range(256, 256 + len(joined))):
            return None
        count = 256 + len(joined)
        ranks = {self.a.data[low : low + size].tobytes(): i for i, (low, size) in enumerate(zip(self.a.starts[:count].tolist(), self.a.lengths[:count].tolist()))}
        if len(ranks) != count or sorted(map(len, list(ranks)[:256])) != [1] * 256:
            return None
        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        others = [k for k, x in enumerate(texts) if self._plain is None or _NEWER.search(x)]
        by_library = [texts[k] for k in others]
        found = self._a.encode_batch_fast([f" {x}" for x in by_library], add_special_tokens=False)
        of_others = {k: x.ids for k, x in zip(others, found)}
        a = [of_others[k] if k in of_others else self._plain(f" {x}") for k, x in enumerate(texts)]
        return a, self._b.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


class _Side:
    """One tokenizer's tokens of several texts, all behind each other."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, strings: _Strings) -> None:
        self.ids, self.counts = ids, counts
        self.ends = np.cumsum(strings.lengths[ids])
        self.starts = self.ends - strings.lengths[ids]
        self.text = np.repeat(np.arange(len(counts)), counts)

    @classmethod
    def of(cls, ids: list[list[int]], strings: _Strings) -> _Side:
        counts = np.array([len(x) for x in ids], np.int64)
        return cls(np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts, strings)

    def same(self, texts: list[bytes], strings: _Strings) -> np.ndarray:
        """Which of the texts the tokens' bytes add up to."""
        sizes = np.array([len(x) for x in texts], np.int64)
        own = np.diff(np.append(0, self.ends)[np.append(0, np.cumsum(self.counts))])
        alike = own == sizes
        mine = strings.joined(self.ids[np.repeat(alike, self.counts)])
        given = np.frombuffer(b"".join(x for x, y in zip(texts, alike.tolist()) if y), np.uint8)
        wrong = np.append(0, np.cumsum(mine != given))[np.append(0, np.cumsum(sizes[alike]))]
        alike[alike] = np.diff(wrong) == 0
        return alike

    def only(self, texts: np.ndarray, strings: _Strings) -> _Side:
        """The tokens of the marked texts."""
        return _Side(self.ids[np.repeat(texts, self.counts)], self.counts[texts], strings)

    def group(self, other: _Side) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens end where one of the other side does, and the group each token is in."""
        there = np.zeros(int(self.ends[-1]) + 1, bool)
        there[other.ends] = True
        last = there[self.ends]
        return last, np.cumsum(last) - last


def align(kit: Tokenizers, texts: list[str]) -> dict[str, np.ndarray | list[bytes]]:
    """Counts and digest for each text, and all links: the text of each and its pair of ids."""
    chosen = [k for k, x in enumerate(texts) if x]
    spaced = [f" {texts[k]}".encode() for k in chosen]
    a, b = (_Side.of(x, y) for x, y in zip(kit.encode([texts[k] for k in chosen]), (kit.a, kit.b)))
    good = a.same(spaced, kit.a) & b.same(spaced, kit.b)
    counts = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [b""] * len(texts)
    if not good.any():
        return counts | {"digests": digests, "of": np.empty(0, np.int64), "pairs": np.empty(0, np.int64)}
    place = np.array(chosen)[good]
    a, b = a.only(good, kit.a), b.only(good, kit.b)
    (last_a, group_a), (last_b, group_b) = a.group(b), b.group(a)
    # The other side's token at each byte tells the first and the last token that one overlaps.
    at_byte = np.repeat(np.arange(len(b.ids), dtype=np.int32), b.ends - b.starts)
    first = at_byte[a.starts].astype(np.int64)
    links = at_byte[a.ends - 1] - first + 1
    link_a, link_b = np.repeat(np.arange(len(a.ids)), links), flat.ragged(first, links)
    # All ids as text: of each group first one side's, then the other's, each followed by a mark.
    before_a = np.append(0, np.cumsum(np.bincount(group_a)))
    before_b = np.append(0, np.cumsum(np.bincount(group_b)))
    size = len(a.ids) + len(b.ids)
    ids, marks = np.empty(size, np.int64), np.empty(size, np.uint8)
    turn_a = np.arange(len(a.ids)) + before_b[group_a]
    turn_b = np.arange(len(b.ids)) + before_a[group_b + 1]
    ids[turn_a], ids[turn_b] = a.ids, b.ids
    marks[turn_a], marks[turn_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits = kit.decimals.lengths[ids]
    ends = np.cumsum(digits + 1)
    line = np.empty(int(ends[-1]), np.uint8)
    line[ends - 1] = marks
    line[flat.ragged(ends - 1 - digits, digits)] = kit.decimals.joined(ids)
    borders = np.append(0, ends[np.cumsum(a.counts + b.counts) - 1])
    for k, low, high in zip(place.tolist(), borders[:-1].tolist(), borders[1:].tolist()):
        digests[k] = hashlib.sha256(line[low : high - 1]).digest()
    counts["n_a"][place], counts["n_b"][place] = a.counts, b.counts
    counts["n_groups"][place] = np.bincount(a.text, last_a, len(place)).astype(np.int64)
    counts["n_links"][place] = np.bincount(a.text, links, len(place)).astype(np.int64)
    return counts | {"digests": digests, "of": place[a.text[link_a]], "pairs": a.ids[link_a] << _ID_BITS | b.ids[link_b]}


def _binaries(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Binary values that lie behind each other in an array, split at the borders."""
    offsets = (borders * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def packed(keys: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Bitmaps of ascending keys, run << 16 | place, one for each run: the runs and their bitmaps.

    A run's places are 16-bit numbers, or, where those are as many bytes, all of a chunk's bits. Sparse
    runs come first, in one array, then the others.
    """
    runs, starts = np.unique(keys >> 16, return_index=True)
    counts = np.diff(np.append(starts, len(keys)))
    places = (keys & 0xFFFF).astype("<u2")
    dense = counts * 2 >= _BITMAP_BYTES
    own = np.repeat(~dense, counts)
    arrays = [_binaries(places[own], np.append(0, np.cumsum(counts[~dense])))]
    if dense.any():
        bits = np.zeros((int(dense.sum()), CHUNK), np.uint8)
        bits[np.repeat(np.arange(len(bits)), counts[dense]), places[~own]] = 1
        arrays.append(_binaries(np.packbits(bits, axis=1, bitorder="little").reshape(-1), np.arange(len(bits) + 1) * _BITMAP_BYTES))
    return np.concatenate([runs[~dense], runs[dense]]), arrays


def unpacked(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each bitmap in turn the places of its documents, and how many each has."""
    data, offsets = flat.flat(bitmaps)
    sizes = np.diff(offsets)
    dense = sizes == _BITMAP_BYTES
    counts = sizes // 2
    if not dense.any():
        return data.view("<u2").astype(np.int64), counts
    bits = np.unpackbits(data[np.repeat(dense, sizes)].reshape(-1, _BITMAP_BYTES), axis=1, bitorder="little")
    counts[dense] = bits.sum(axis=1, dtype=np.int64)
    places = np.empty(int(counts.sum()), np.int64)
    own = np.repeat(dense, counts)
    places[own], places[~own] = np.nonzero(bits)[1], np.ascontiguousarray(data[np.repeat(~dense, sizes)]).view("<u2")
    return places, counts


def _rows(size: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch with the given columns and nulls in the others."""
    arrays = [pa.array(columns[c], kind) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(size, kind)) for c, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


class _Postings:
    """Links of one chunk, as (pair, document, how often), until they are given out."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, places: np.ndarray) -> None:
        keys, times = np.unique(pairs << 16 | places, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def __len__(self) -> int:
        return sum(map(len, self.keys))

    def bitmaps(self, chunk: int) -> Iterator[pa.RecordBatch]:
        if not len(self):
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        for plane in range(int(times.max()).bit_length()):
            pairs, arrays = packed(keys[times >> plane & 1 == 1])
            at = 0
            for bitmaps in arrays:
                own = pairs[at : at + len(bitmaps)]
                at += len(own)
                if len(own):
                    yield _rows(len(own), chunk=np.full(len(own), chunk), pair=own, plane=np.full(len(own), plane), bitmap=bitmaps)
        self.keys, self.times = [], []


def aligned(documents: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents and bitmaps, as rows of one table written to the shared folder.

    A document's row has its counts and its place in a chunk, a bitmap's row the pair of ids, the chunk
    and the binary digit. Texts are encoded where they lie, and once.
    """
    spark = documents.sparkSession
    given = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit, postings, seen = tokenizers(byte_level, pieces), _Postings(), 0
        task = TaskContext.get().partitionId() << 32
        for whole in batches:
            for group in flat.row_groups(whole, "text", _GROUP_BYTES):
                while group.num_rows:
                    # A group ends with its chunk.
                    batch = group.slice(0, CHUNK - seen % CHUNK)
                    group = group.slice(batch.num_rows)
                    chunk, places = task + seen // CHUNK, np.arange(batch.num_rows) + seen % CHUNK
                    found = align(kit, batch.column("text").fill_null("").to_pylist())
                    yield _rows(
                        batch.num_rows, chunk=np.full(batch.num_rows, chunk), place=places, doc_id=batch.column("doc_id"),
                        sha256=pa.array(found["digests"], pa.binary()),
                        **{c: found[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
                    )
                    postings.add(found["pairs"], places[found["of"]])
                    seen += batch.num_rows
                    if len(postings) >= POSTINGS or seen % CHUNK == 0:
                        yield from postings.bitmaps(chunk)
        if seen:
            yield from postings.bitmaps(task + (seen - 1) // CHUNK)

    folder = new_folder(spark, "alignment")
    given.mapInArrow(run, _ALIGNED).write.parquet(folder)
    return spark.read.schema(_ALIGNED).parquet(folder)


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One row (pair, chunk, plane, bitmap, links, documents) for each plane, equal ones OR-ed.

    `links` is the plane's share of the links. `documents`, how many of the chunk's documents have the
    pair, stands on the first plane's row and is 0 on the others. A pair of all documents is spread by
    chunks.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            pair, chunk = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            more = (pair == pair[-1]) & (chunk == chunk[-1])
            tail = whole.num_rows - int(more.sum())  # rows are sorted, so these are the last ones
            if tail:
                yield settle(whole.slice(0, tail))
            held = whole.slice(tail)
        if held is not None:
            yield settle(held)

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        names = [rows.column(k).to_numpy() for k in range(3)]
        new_group = np.append(True, (np.diff(names[0]) != 0) | (np.diff(names[1]) != 0))
        new = new_group | np.append(True, np.diff(names[2]) != 0)
        run, group = np.cumsum(new) - 1, np.cumsum(new_group) - 1
        places, counts = unpacked(rows.column(3))
        documents = np.bincount(np.unique(np.repeat(group, counts) << 16 | places) >> 16, minlength=int(group[-1]) + 1)
        keys = np.unique(np.repeat(run, counts) << 16 | places)
        runs, arrays = packed(keys)
        head = np.flatnonzero(new)
        first = new_group[head]
        links = np.bincount(keys >> 16, minlength=len(head)) << names[2][head]
        all_documents = np.where(first, documents[group[head]], 0)
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array(x[head[runs]]) for x in names],
                pa.concat_arrays(arrays), pa.array(links[runs]), pa.array(all_documents[runs]),
            ],
            names=["pair", "chunk", "plane", "bitmap", "links", "documents"],
        )

    return (
        bitmaps.select("pair", "chunk", "plane", "bitmap")
        .repartition("pair", "chunk")
        .sortWithinPartitions("pair", "chunk", "plane")
        .mapInArrow(merge, "pair bigint, chunk bigint, plane int, bitmap binary, links bigint, documents bigint")
    )


def pair_counts(merged: DataFrame) -> DataFrame:
    """(pair, a, b, links, documents, planes): in how many links and documents each pair of ids is, and
    how many rows `merged` has of it."""
    sums = merged.groupBy("pair").agg(
        F.sum("links").alias("links"), F.sum("documents").alias("documents"), F.count("*").alias("planes")
    )
    ids = F.shiftright("pair", _ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << _ID_BITS) - 1).alias("b")
    return sums.select("pair", *ids, "links", "documents", "planes")


def _returned(rows: DataFrame) -> DataFrame:
    """Documents with the sums over their links, from the bitmaps and documents of each chunk.

    A task takes a chunk's bitmaps one after the other and adds to the sums of the documents in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, sums = None, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
        for whole in batches:
            chunks = whole.column(0).to_numpy()
            borders = np.append(np.flatnonzero(np.append(True, np.diff(chunks) != 0)), len(chunks))
            for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
                batch = whole.slice(low, high - low)
                if now != chunks[low]:
                    now = chunks[low]
                    best[:], sums[:] = 0, 0
                is_bitmap = batch.column(1).is_valid()
                bitmaps = batch.filter(is_bitmap)
                if bitmaps.num_rows:
                    places, counts = unpacked(bitmaps.column(2))
                    links, is_best = bitmaps.column(3).to_numpy(), bitmaps.column(4).to_numpy(zero_copy_only=False)
                    times = np.int64(1) << bitmaps.column(1).to_numpy().astype(np.int64)
                    np.add.at(sums, places, np.repeat(times * links, counts))
                    np.add.at(best, places, np.repeat(times * is_best, counts))
                documents = batch.filter(pa.array(~is_bitmap.to_numpy(zero_copy_only=False)))
                if documents.num_rows:
                    own = documents.column("place").to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            documents.column("doc_id"),
                            *[documents.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                            pa.array(best[own]), pa.array(sums[own]), documents.column("sha256"),
                        ],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha256"],
                    )

    return rows.mapInArrow(
        run,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, sha256 binary",
    )


def cross_alignment(documents: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: tokens, groups and links of both tokenizers, and how common its links are.

    `byte_level` names the first tokenizer's file, of the tokenizers library, which is given a space
    and the text; `pieces` the second's, of the sentencepiece library, which adds the space itself.
    Tokens whose bytes overlap are linked; where tokens of both end, a group ends. `n_best` counts
    links whose pair of ids no other pair with that second id outnumbers, ties included, `count_sum`
    adds up how often each link's pair is linked in all documents. Null and empty texts, and those
    that a tokenizer does not give back byte by byte, have no tokens: zeros, and no digest. Strings of
    special tokens are plain text. A long text is encoded whole, alone in its group. Ids may be null or
    repeated, each row is a document; other columns are not read.
    """
    rows = aligned(documents, byte_level, pieces, doc_id, text)
    merged = cut_lineage(merged_bitmaps(rows.filter("pair is not null")))
    counts = cut_lineage(pair_counts(merged))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    scored = counts.join(most, "b").select(
        "pair", F.col("links").alias("count"), (F.col("links") == F.col("most")).alias("best"), "planes"
    )
    bitmaps = join_groups(merged.select("pair", "chunk", "plane", "bitmap"), scored, "pair", "planes", "chunk")
    own = [c.split()[0] for c in _DOCUMENT.split(", ")]
    both = bitmaps.select("chunk", "plane", "bitmap", "count", "best").unionByName(
        rows.filter("pair is null").select("chunk", *own), allowMissingColumns=True
    )
    # Bitmaps first, documents behind them.
    by_chunk = both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("plane"))
    found = _returned(by_chunk)
    return found.withColumn("groups_sha256", F.lower(F.hex("sha256"))).drop("sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers are linked in every document."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return cross_alignment(table(spark, sf_dir, "documents"), *files)
