"""A run-length compressed index of a collection of byte strings, and matching statistics on it.

The Burrows-Wheeler transform of the collection is kept as runs of equal symbols, with the place of
the suffix at both ends of every run. A pattern is streamed through it from its end: where the
symbol agrees with the run at hand the match grows by one; else it goes on at the nearer run end with
that symbol, above or below, whichever suffix agrees longer. So each position of the pattern gets the
length of its longest match in the collection and a place of it. All patterns take their steps
together, as arrays.
"""

from __future__ import annotations

import numpy as np

from fileledger.llm import flat

_SEPARATOR = 0  # symbols are bytes plus one


#: Most symbols in a key of 63 bits, and by how many at most a rank is kept.
_WIDTH = 9
_COARSE = 28


def _keys(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """For each place its first symbols as one number, zero behind a separator, and how many they are."""
    used = np.flatnonzero(np.bincount(symbols))  # the separator is the first
    bits = max(1, (len(used) - 1).bit_length())
    code = np.zeros(int(used[-1]) + 1, np.int64)
    code[used] = np.arange(len(used))
    width = min(_WIDTH, 63 // bits)
    key, have = code[symbols], 1
    while have < width:
        # As many symbols again, of which the last may be too many.
        more = min(have, width - have)
        behind = np.zeros_like(key)
        behind[:-have] = key[have:] >> bits * (have - more)
        behind[left <= have] = 0
        key = key << bits * more | behind
        have += more
    return key, width


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The sorted suffixes, for each place its rank by its first symbols, and by how many of them.

    Strings end with a separator, at `ends`; separators sort before all else and by their place, so
    no comparison goes on beyond one.
    """
    size = len(symbols)
    place = np.arange(size, dtype=np.int32)
    end = np.repeat(ends.astype(np.int32), np.diff(np.append(-1, ends)))
    left = end - place
    key, depth = _keys(symbols, left)
    order = np.argsort(key)
    in_order = key[order]
    head = np.append(True, in_order[1:] != in_order[:-1])
    rank = np.empty(size, np.int32)  # the row where a suffix's group of ties begins
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    times = 3 if size < 1 << 21 else 2  # ranks in a key
    while True:
        if depth <= _COARSE:
            coarse, known, rank = rank, depth, rank.copy()
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        # Ties agree in the places of separators; those with one in reach differ by which it is.
        own = order[tied]
        own_left = left[own]
        key = rank[own].astype(np.int64)
        for k in range(1, times):
            behind = end[own]
            far = np.flatnonzero(own_left >= k * depth)
            behind[far] = rank[own[far] + k * depth]
            key = key * size + behind
        by_key = np.argsort(key)
        own, key = own[by_key], key[by_key]
        new = np.append(True, key[1:] != key[:-1])
        head[tied] = new
        order[tied] = own
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= times
    return order, coarse, known


class RunIndex:
    """Index of strings given behind each other, with the length of each; none is empty."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        symbols = np.full(len(data) + len(lengths), _SEPARATOR, np.int16)
        symbols[flat.ragged(self.starts, lengths)] = data.astype(np.int16) + 1
        suffixes, self._coarse, self._depth = suffix_array(symbols, ends)
        self._suffixes = suffixes  # for blocks() only, see there
        transform = symbols[suffixes - 1]
        heads = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
        sizes = np.diff(np.append(heads, len(transform)))
        self.symbols = symbols
        self.run_starts, self.run_symbols = heads, transform[heads].astype(np.int64)
        # Suffixes at the first and the last row of each run.
        self.first, self.last = suffixes[heads], suffixes[heads + sizes - 1]
        # How far a step from a row of a run leads.
        by_symbol = np.argsort(self.run_symbols, kind="stable")
        self.steps = -heads
        self.steps[by_symbol] += np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        self.run_ends = heads + sizes - 1
        self.run_of = np.repeat(np.arange(len(heads)), sizes)
        # Runs in the order of (symbol, run).
        self.by_symbol = self.run_symbols[by_symbol] * len(heads) + by_symbol

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the blocks of suffixes that agree in `length` symbols, and the first place
        in the collection of each block. `length` is 28 at least.

        Called once, when the index has been built; the sorted suffixes are then given up.
        """
        rows, rank, depth = self._suffixes, self._coarse, self._depth
        del self._suffixes, self._coarse
        rank = np.append(rank, np.full(length, -1, rank.dtype))
        new = np.ones(len(rows), bool)
        new[1:] = False
        for behind in (*range(0, length - depth, depth), length - depth):
            ranks = rank[rows + behind]
            new[1:] |= ranks[1:] != ranks[:-1]
        heads = np.flatnonzero(new)
        return heads, np.minimum.reduceat(rows, heads)

    def _agreement(self, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from two places on agree, up to `most`."""
        width = int(most.max(initial=0))
        if not width:
            return np.zeros(len(one), np.int64)
        reach = np.arange(width)
        last = len(self.symbols) - 1
        same = self.symbols[np.minimum(one[:, None] + reach, last)] == self.symbols[np.minimum(other[:, None] + reach, last)]
        agreed = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        return np.minimum(agreed, most)

    def step(self, row: np.ndarray, place: np.ndarray, length: np.ndarray, symbol: np.ndarray):
        """One symbol more, to the left, for all patterns: their new rows, places and match lengths."""
        runs = len(self.run_starts)
        run = self.run_of[row]
        off = np.flatnonzero(self.run_symbols[run] != symbol)
        if not len(off):
            return self.steps[run] + row, place - 1, length + 1
        row, place, length = row.copy(), place.copy(), length.copy()
        at = np.searchsorted(self.by_symbol, symbol[off] * runs + run[off])
        best_length = np.full(len(off), -1)
        best_run, best_row, best_place = run[off].copy(), row[off].copy(), place[off].copy()
        for shift, rows, places in ((-1, self.run_ends, self.last), (0, self.run_starts, self.first)):
            k = np.clip(at + shift, 0, len(self.by_symbol) - 1)
            there = (at + shift == k) & (self.by_symbol[k] // runs == symbol[off])
            other = self.by_symbol[k] % runs
            agreed = np.full(len(off), -1)
            agreed[there] = self._agreement(place[off][there], places[other[there]], length[off][there])
            better = agreed > best_length
            best_length[better] = agreed[better]
            best_run[better], best_row[better] = other[better], rows[other[better]]
            best_place[better] = places[other[better]]
        run[off], row[off], place[off], length[off] = best_run, best_row, best_place, best_length
        row, place, length = self.steps[run] + row, place - 1, length + 1
        lost = off[best_length < 0]  # no run has the symbol
        row[lost], place[lost], length[lost] = 0, self.first[0], 0
        return row, place, length

    def matching_statistics(self, data: np.ndarray, lengths: np.ndarray):
        """For each byte of the patterns: the length of the longest match that starts there, and the
        row and the place of one. Patterns are given behind each other."""
        ends = np.cumsum(lengths)
        out_length, out_row, out_place = (np.zeros(len(data), np.int64) for _ in range(3))
        by_length = np.argsort(-lengths, kind="stable")
        ends, sizes = ends[by_length], lengths[by_length]
        row = np.zeros(len(sizes), np.int64)
        place, length = np.full(len(sizes), self.first[0]), np.zeros(len(sizes), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            active = int(np.searchsorted(-sizes, -t, side="right"))
            row, place, length = row[:active], place[:active], length[:active]
            at = ends[:active] - t
            row, place, length = self.step(row, place, length, data[at].astype(np.int64) + 1)
            out_length[at], out_row[at], out_place[at] = length, row, place
        return out_length, out_row, out_place
