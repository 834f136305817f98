"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

The symbols of all distinct words of some MB of text lie in one flat array. Each round finds the
best pair rank per word, merges the leftmost such pairs of all words at once, and closes the gaps;
words without a pair leave the array. Long words' places wait by rank in linked arrays instead, so
that a round touches its own places and their neighbours only. It gives the ids of the library's own encoder, which merges
the best pair of a sentence again and again, leftmost on ties: in such a vocabulary no piece goes
on after a word's end, so words don't influence each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from heapq import heappop, heappush
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from fileledger.llm import flat
from fileledger.llm.rows import add_columns, table
from fileledger.llm.words import WordIds

_NONE = np.int32(2**31 - 1)
_SPACE = 0x20
#: Characters from which a word is long: rounds over all of it would take time with their square.
LONG_WORD = 128
#: Places in a row that wait for each other and are looked at together.
_CHAIN = 32


class Vocabulary:
    """Pieces, merges and byte fall-back of a model, as arrays."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        #: Pieces that text can hold, with the space written as such.
        ids = {name.replace("▁", " "): i for i, name in enumerate(names) if not special[i]}
        if any(" " in name.lstrip(" ") for name in ids):
            raise ValueError("a piece goes on after a space: words can't be encoded on their own")
        if any(name.startswith("  ") and name.strip(" ") for name in ids):
            raise ValueError("a piece has letters behind two spaces")
        self.longest = max(map(len, ids))
        scores = np.array([model.get_score(i) for i in range(size)])
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.unknown = size
        self.char_ids = np.full(0x110000, size, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.char_ids[ord(name)] = i
        self.space = ids[" "]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        pairs, merged = [], []
        for name, i in ids.items():
            if name.strip(" "):  # runs of spaces are merged last, see space_run
                for cut in range(1, len(name)):
                    left, right = ids.get(name[:cut]), ids.get(name[cut:])
                    if left is not None and right is not None:
                        pairs.append(left * (size + 1) + right)
                        merged.append(i)
        order = np.argsort(pairs)
        pairs, merged = np.array(pairs, np.int64)[order], np.array(merged, np.int32)[order]
        self._table(pairs, merged)
        self.ranks = np.append(ranks, _NONE)
        # A merge may be done at all its places in one go if no later merge of its piece goes before it.
        after = np.full(size + 1, _NONE, np.int32)
        np.minimum.at(after, pairs // (size + 1), ranks[merged])
        np.minimum.at(after, pairs % (size + 1), ranks[merged])
        self.at_once = after > self.ranks
        self.space_runs = {len(n): i for n, i in ids.items() if not n.strip(" ")}
        self._known_runs: dict[int, np.ndarray] = {}
        self.words = WordIds(self._encode_bytes)
        # For decoding: the bytes of each piece.
        raw = [
            bytes([int(names[i][3:5], 16)]) if model.is_byte(i)
            else " ⁇ ".encode() if model.is_unknown(i)
            else b"" if model.is_control(i)
            else names[i].replace("▁", " ").encode()
            for i in range(size)
        ]
        self.piece_lengths = np.array([len(x) for x in raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _table(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        """A hash table of the pairs in flat arrays, looked up for many pairs at once."""
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        keys = np.full(1 << self.bits, -1, np.int64)
        values = np.full(1 << self.bits, -1, np.int32)
        left, slots = np.arange(len(pairs)), self._slots(pairs)
        self.probes = 0
        while len(left):
            free = keys[slots] < 0
            first = np.unique(slots[free], return_index=True)[1]
            placed = np.flatnonzero(free)[first]
            keys[slots[placed]], values[slots[placed]] = pairs[left[placed]], merged[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slots = left[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.keys, self.values = keys, values

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to, or the unknown id."""
        pairs = left.astype(np.int64) * (self.unknown + 1) + right
        out = np.full(len(pairs), self.unknown, np.int32)
        slots, open_ = self._slots(pairs), np.arange(len(pairs))
        for _ in range(self.probes):
            keys = self.keys[slots]
            hit = keys == pairs[open_]
            out[open_[hit]] = self.values[slots[hit]]
            go = ~hit & (keys >= 0)
            open_, slots = open_[go], (slots[go] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return out

    def space_run(self, count: int) -> np.ndarray:
        """Ids of `count` single spaces: all their merges tie, so the leftmost always goes first."""
        if count not in self._known_runs:
            stack: list[int] = []
            for _ in range(count):
                stack.append(1)
                while len(stack) > 1 and stack[-2] + stack[-1] in self.space_runs:
                    stack[-2:] = [stack[-2] + stack[-1]]
            self._known_runs[count] = np.array([self.space_runs[n] for n in stack], np.int32)
        return self._known_runs[count]

    def _encode_bytes(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = np.cumsum(np.append(0, (text & 0xC0) != 0x80))
        points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
        return self.encode_words(points, np.diff(chars[np.append(0, np.cumsum(lengths))]))

    def encode_words(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as code points behind each other, and how many each word has."""
        symbols = self.char_ids[points]
        word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(points))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = np.repeat(lengths > LONG_WORD, lengths)
        if long.any():
            done.append(self._by_rank(symbols[long], word[long], place[long]))
            symbols, word, place = symbols[~long], word[~long], place[~long]
        last = np.ones(len(symbols), bool)
        last[:-1] = word[1:] != word[:-1]
        merged = np.full(len(symbols), self.unknown, np.int32)
        pairs = np.flatnonzero(~last)
        merged[pairs] = self.merge_of(symbols[pairs], symbols[pairs + 1])
        while len(symbols):
            rank = self.ranks[merged]
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(word)))
            open_ = best < _NONE
            if not open_.all():  # words without a pair leave
                go = np.repeat(open_, sizes)
                done.append((word[~go], symbols[~go], place[~go]))
                symbols, word, place, merged, rank = (x[go] for x in (symbols, word, place, merged, rank))
                best, sizes = best[open_], sizes[open_]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of places in a row every other one, from the left; one place only where a merge may
            # bring a better pair.
            row = np.append(True, np.diff(at) != 1)
            behind = _behind(row)
            first = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[(behind % 2 == 0) & (first | self.at_once[merged[at]])]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, word, place, merged = (x[keep] for x in (symbols, word, place, merged))
            # Only pairs beside a merged symbol are new.
            touched = np.zeros(len(word) + 1, bool)
            touched[new] = touched[new - 1] = True  # before the first symbol it is the spare entry
            changed = np.flatnonzero(touched[:-1])
            inner = changed < len(word) - 1
            inner[inner] = word[changed[inner]] == word[changed[inner] + 1]
            merged[changed] = self.unknown
            changed = changed[inner]
            merged[changed] = self.merge_of(symbols[changed], symbols[changed + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        word, symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._finish(word[order], symbols[order], place[order], points, len(lengths))

    def _by_rank(self, symbols: np.ndarray, word: np.ndarray, place: np.ndarray):
        """The rounds for long words: each merges places of the best rank that waits anywhere.

        Words don't touch each other, so a word's places of that rank are its best. Where a merge may
        bring a better pair, that pair and all it leads to hold the place merged, so they lie within
        the longest piece around it: places twice that apart can't meet, and go in one round.
        """
        size = len(symbols)
        new = np.append(True, word[1:] != word[:-1])
        # `size` stands for no neighbour; its symbol has no pairs.
        before = np.where(new, size, np.arange(-1, size - 1))
        before = np.append(before, size)
        after = np.where(np.append(new[1:], True), size, np.arange(1, size + 1))
        symbols = np.append(symbols, np.int32(self.unknown))
        merged = np.full(size + 1, self.unknown, np.int32)
        merged[:size] = self.merge_of(symbols[:size], symbols[after])
        alive = np.ones(size, bool)
        #: Places by rank: new ones, and those of a rank begun, what comes next at the end.
        waiting: dict[int, list[np.ndarray]] = {}
        begun: dict[int, list[np.ndarray]] = {}
        open_: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = self.ranks[merged[places]]
            order = np.argsort(ranks, kind="stable")
            order = order[: np.searchsorted(ranks[order], _NONE)]
            places, ranks = places[order], ranks[order]
            heads = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))[: len(ranks)]
            for rank, part in zip(ranks[heads].tolist(), np.split(places, heads[1:]), strict=False):
                if rank not in waiting and rank not in begun:
                    heappush(open_, rank)
                waiting.setdefault(rank, []).append(part)

        wait(np.arange(size))
        while open_:
            rank = open_[0]
            if rank in waiting:
                # Once the rank is begun these lie left of what is left over near them.
                at = np.unique(np.concatenate(waiting.pop(rank)))
                begun.setdefault(rank, [])
            elif begun[rank]:
                at = begun[rank].pop()
            else:
                del begun[heappop(open_)]
                continue
            at = at[self.ranks[merged[at]] == rank]  # others have changed since
            if not len(at):
                continue
            if self.at_once[merged[at]].all():
                row = np.append(True, after[at[:-1]] != at[1:])
                take = _behind(row) % 2 == 0
            else:
                apart = (at[1:] - at[:-1] > 2 * self.longest) | (word[at[1:]] != word[at[:-1]])
                chain = np.append(True, apart)
                behind, heads = _behind(chain), np.flatnonzero(chain)
                lengths = np.diff(np.append(heads, len(at)))
                if lengths.max() > _CHAIN:  # the first halves of chains go first
                    half = behind < np.repeat(np.maximum(_CHAIN, (lengths + 1) // 2), lengths)
                    begun[rank] += [at[~half], at[half]]
                    continue
                take = chain
            if not take.all():
                begun[rank].append(at[~take])
            at = at[take]
            gone = after[at]
            symbols[at] = merged[at]
            merged[gone] = self.unknown
            alive[gone] = False
            after[at] = after[gone]
            before[after[at]] = at
            changed = np.unique(np.append(at, before[at]))
            changed = changed[changed < size]
            merged[changed] = self.merge_of(symbols[changed], symbols[after[changed]])
            wait(changed)
        return word[alive], symbols[:-1][alive], place[alive]

    def _finish(self, word, symbols, place, points, words):
        """Merge runs of spaces, and write unknown characters as bytes."""
        sizes = np.bincount(word, minlength=words)
        space = symbols == self.space
        run = space & np.append(False, space[:-1] & (word[1:] == word[:-1]))
        unknown = symbols == self.unknown
        if not run.any() and not unknown.any():
            return symbols, sizes
        heads = np.flatnonzero(~run)
        lengths = np.diff(np.append(heads, len(symbols)))
        symbols, word, place, unknown = symbols[heads], word[heads], place[heads], unknown[heads]
        repeat = np.ones(len(symbols), np.int64)
        texts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero((lengths > 1) | unknown):
            texts[i] = (
                self.byte_ids[list(chr(points[place[i]]).encode())] if unknown[i] else self.space_run(int(lengths[i]))
            )
            repeat[i] = len(texts[i])
        starts = np.cumsum(repeat) - repeat
        out = np.repeat(symbols, repeat)
        for i, ids in texts.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, np.bincount(word, weights=repeat, minlength=words).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text's begin."""
        # A space goes before each text, and a written space mark is a space.
        padded = [b" " + x.replace(b"\xe2\x96\x81", b" ") if x else b"" for x in texts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in padded], out=offsets[1:])
        whole = b"".join(padded)
        data = np.frombuffer(whole, np.uint8)
        space = data == _SPACE
        start = space & ~np.append(False, space[:-1])
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        ids, counts = self.words.of(data, starts, ends)
        before = np.append(0, np.cumsum(counts))
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts in front."""
        lengths = self.piece_lengths[ids]
        text = self.piece_bytes[flat.ragged(self.piece_starts[ids], lengths)].tobytes()
        return text[1:] if text.startswith(b" ") else text


def _behind(heads: np.ndarray) -> np.ndarray:
    """How far each entry is behind the last one marked."""
    return np.arange(len(heads)) - np.flatnonzero(heads)[np.cumsum(heads) - 1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def clean_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty, and what is not UTF-8 is replaced as decoders do."""
    texts = column.cast(pa.binary()).fill_null(b"").to_pylist()
    try:
        for text in texts:
            text.decode()
    except UnicodeDecodeError:
        texts = [text.decode("utf-8", "replace").encode() for text in texts]
    return texts


def piece_ids(
    documents: DataFrame, model: str, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add `piece_ids` and `decoded`, the text that the ids stand for, to each row.

    Rows are encoded where they lie, without a shuffle. A null or empty text has no ids and decodes
    to an empty text; repeated rows are encoded each. Long texts, and long words without a space, take
    time in proportion to their length. Other columns stay; those called like the new
    ones are replaced.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, starts, decoded = _both_ways(batch.column(text), model)
        return [
            pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())),
            pa.array(decoded, pa.binary()).cast(pa.string()),
        ]

    fields = [StructField("piece_ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    return add_columns(documents, fields, compute, text, keep)


def piece_digests(
    documents: DataFrame, model: str, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """As `piece_ids`, with `n_tokens` and SHA-256 digests of ids and decoded text in their place."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, starts, decoded = _both_ways(batch.column(text), model)
        listed = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return [
            pa.array(np.diff(starts), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ]

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    return add_columns(documents, fields, compute, text, keep)


def _both_ways(column: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    pieces = vocabulary(model)
    ids, starts = pieces.encode(clean_texts(column))
    return ids, starts, [pieces.decode(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, for every document."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
