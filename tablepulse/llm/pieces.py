"""Ids of texts whose pieces encode independently: each distinct piece is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, islice

import numpy as np

MAX_BYTES = 64 << 20
ENTRY_BYTES = 120  # a key, its number and their place in the table, less the letters


class Numbers(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i] .. begin[i] + size[i] - 1`` of each i, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class PieceCache:
    """Ids by piece, from a function that encodes a list of new pieces.

    The cache is emptied when it holds about ``MAX_BYTES``, which bounds its memory and
    changes no result.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.held = 0
        self.starts = np.zeros(1, np.int64)  # starts[i] .. starts[i + 1]: ids of piece i
        self.flat = np.empty(0, np.int32)

    def ids(self, texts: Sequence[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each given as its list of pieces, and where each text ends among them."""
        pieces = list(chain.from_iterable(texts))
        return self.coded(pieces, None, np.cumsum([len(t) for t in texts], dtype=np.int64))

    def coded(self, pieces: list, places: np.ndarray | None, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids`` for texts whose n-th piece is ``pieces[places[n]]``; ``text_ends`` counts the pieces up to each text's end."""
        if self.held > MAX_BYTES:
            self.clear()
        known = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.number) > known:
            new = list(islice(self.number, known, None))
            lengths, flat = self.encode(new)
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(lengths)]
            self.flat = np.r_[self.flat, flat.astype(np.int32)]
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new) + 4 * len(flat)
        if places is not None:
            codes = codes[places]
        begin = self.starts[codes]
        size = self.starts[codes + 1] - begin
        return self.flat[spans(begin, size)], np.r_[0, np.cumsum(size)][text_ends]


def slices(values, limit: int = 2 << 20):
    """Runs ``(start, stop)`` of an Arrow string column with about ``limit`` bytes of text each."""
    start, size = 0, 0
    for i, value in enumerate(values):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
