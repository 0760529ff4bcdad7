"""Byte-level BPE by a rank file, on padded numpy matrices, and its inverse.

Distinct pieces of a batch are dealt into matrices by length, one row of byte ids each.
Each round every row merges its leftmost pair of smallest rank; both matrices (ids and the
ranks of neighbouring pairs) lose one column, finished rows leave.  Ranks come from an open
hash table over id pairs.  Pieces above ``LONG`` bytes are merged alone: there a round merges
all separate places of the smallest rank at once, which equals merging them one after the
other unless some pair with the new id has a smaller rank (then one place is merged).

Rows: a NULL or empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablepulse.llm.pieces import PieceCache, slices, spans
from tablepulse.llm.storage import ship, tidied

LONG = 128
ROWS = 1 << 14
NONE = np.int64(1) << 40  # rank of a pair that does not merge
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, Ranks] = {}


class Ranks:
    """Vocabulary of a rank file with its table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        lefts, rights, merged = [], [], []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    merged.append(rank)
        left, right, value = (np.array(x, np.int64) for x in (lefts, rights, merged))
        lowest = np.full(len(self.bytes_of), NONE)
        np.minimum.at(lowest, left, value)
        np.minimum.at(lowest, right, value)
        #: Pairs with this id all rank after it.
        self.in_order = lowest > np.arange(len(lowest))
        self._fill((left << 20 | right).astype(np.uint64), value)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(len(keys) * 3)))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE)
        place, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[place[left]] == np.iinfo(np.uint64).max
            _, first = np.unique(place[left][free], return_index=True)
            put = left[free][first]
            self.keys[place[put]], self.values[place[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            place[left] = (place[left] + 1) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE for pairs that do not merge or hold padding (-1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE)
        todo = np.flatnonzero(right >= 0)
        keys = (left[todo] << 20 | right[todo]).astype(np.uint64)
        place = self._home(keys)
        for _ in range(self.probes):
            found = self.keys[place]
            hit = found == keys
            out[todo[hit]] = self.values[place[hit]]
            open_ = ~hit & (found != np.iinfo(np.uint64).max)
            if not open_.any():
                break
            todo, keys, place = todo[open_], keys[open_], (place[open_] + 1) & self.mask
        return out.reshape(shape)

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Final ids of every row of a matrix padded with -1, padded alike."""
        out = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                out[rows[over], : ids.shape[1]] = ids[over]
                stay = ~over
                rows, ids, ranks, at, best = rows[stay], ids[stay], ranks[stay], at[stay], best[stay]
                if not len(rows):
                    break
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            if width > 2:
                after = np.flatnonzero(at < width - 2)
                ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if self.in_order[least]:
                # Of touching places every second one merges, from the left.
                first = np.r_[True, np.diff(at) > 1]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            else:
                at = at[:1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            at = at - np.arange(len(at))  # places of the new ids
            ranks = ranks[keep[1:]] if keep[0] else ranks
            touched = np.unique(np.r_[at, at - 1])
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            ranks = ranks[: len(ids) - 1]
            ranks[touched] = self.rank(ids[touched], ids[touched + 1])
        return ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order."""
        lengths = np.zeros(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pieces, their ids
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        lengths[known] = 1
        done.append((known, whole[known]))
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            ids = self._merge_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
            lengths[i] = len(ids)
            done.append((np.array([i]), ids))
        width, low = 4, 0
        while low < LONG:
            numbers = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= width))
            for at in range(0, len(numbers), ROWS):
                chosen = numbers[at : at + ROWS]
                matrix = np.full((len(chosen), width), -1, np.int64)
                matrix[np.arange(width) < sizes[chosen][:, None]] = self.byte_ids[
                    np.frombuffer(b"".join([pieces[i] for i in chosen.tolist()]), np.uint8)
                ]
                final = self._merge_rows(matrix)
                real = final >= 0
                lengths[chosen] = real.sum(axis=1)
                done.append((chosen, final[real]))
            width, low = width * 2, width
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int64)
        for chosen, ids in done:
            flat[spans(starts[chosen], lengths[chosen])] = ids
        return lengths, flat


def load(path: str) -> Ranks:
    """The tables of a rank file; each worker process builds them once."""
    if path not in _LOADED:
        ranks = _LOADED[path] = Ranks(path)
        ranks.cache = PieceCache(lambda new: ranks.encode([p.encode("utf-8", "surrogatepass") for p in new]))
    return _LOADED[path]


def recode(
    docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded"
) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the text and, if named, the bytes that they decode to.

    ``rank_file`` must be readable on every executor, as installed libraries are.  Each match
    of ``pattern`` is encoded separately.  Columns of the two names are replaced.
    """
    ship(docs.sparkSession)
    made = [ids, *([decoded] if decoded else [])]
    base = docs.drop(*[c for c in made if c != text])
    at = base.columns.index(text)
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{ids}` array<int>"]
        + ([f"`{decoded}` binary"] if decoded else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find = load(rank_file), regex.compile(pattern).findall
        for whole in batches:
            for start, stop in slices(whole.column(at)):
                batch = whole.slice(start, stop - start)
                flat, ends = ranks.cache.ids([find(v) if v else [] for v in batch.column(at).to_pylist()])
                offsets = np.r_[0, ends]
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
                if decoded:
                    token = ranks.bytes_of.__getitem__
                    found = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:])]
                    columns.append(pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *made])

    return base.mapInArrow(tidied(run, lambda: load(rank_file).cache.clear()), schema)


def decode(coded: DataFrame, rank_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids; NULL ids give no bytes."""
    ship(coded.sparkSession)
    base = coded.drop(decoded)
    at = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load(rank_file).bytes_of.__getitem__
        for batch in batches:
            found = [b"".join(map(token, x.values.to_pylist())) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, decoded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(tidied(run), f"{fields}, `{decoded}` binary")
