"""Token ids of words, each distinct word encoded once while a task remembers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fileledger.llm import flat

#: A task forgets the words it has met once there are more; they are encoded again when met.
MOST_WORDS = 1_000_000


class WordIds:
    """`encode` takes distinct words' bytes behind each other and their lengths in bytes, and gives
    their ids behind each other and how many each word has."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes of words, where their ids begin, how many they are, and all ids.
        self._known = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at the given spans behind each other, and how many each has."""
        hashes = flat.span_hashes(data, starts, ends)
        words, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(words, data, starts[index], ends[index])
        known, begins, counts, ids = self._known
        own = np.searchsorted(known, words)[inverse]
        counts = counts[own]
        return ids[flat.ragged(begins[own], counts)], counts

    def _learn(self, words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self._known[0]) > MOST_WORDS:
            self._forget()
        known, begins, counts, ids = self._known
        place = np.searchsorted(known, words)
        new = (place == len(known)) | (np.append(known, np.uint64(0))[place] != words)
        if not new.any():
            return
        lengths = (ends - starts)[new]
        more, sizes = self._encode(data[flat.ragged(starts[new], lengths)], lengths)
        known = np.append(known, words[new])
        order = np.argsort(known, kind="stable")
        begins = np.append(begins, np.cumsum(sizes) - sizes + len(ids))[order]
        self._known = known[order], begins, np.append(counts, sizes)[order], np.append(ids, more)
