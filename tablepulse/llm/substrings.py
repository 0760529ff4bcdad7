"""Removal of word passages that an earlier document already has, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash of
``SEED_WORDS`` consecutive words inside it, so equal windows have equal minimisers.
Consecutive windows of a text that share their minimiser form a super-k-mer and travel as
one packed string to the bucket of the minimiser; windows that overlap cost their words
once.  Tasks send a bucket its strings in compressed blocks.  In the bucket the strings are
sorted by minimiser and id, and windows are compared word for word.

Hot passages: inside a task, equal strings of different documents are settled at once, as
all but the smallest id lose them, so a passage sends one string per task.  A bucket that
still exceeds ``BUCKET_BYTES`` is not held in memory: its windows are dealt out anew by a
128-bit hash of the whole window, minima are combined in the tasks before the shuffle and
joined back.

Rows: a NULL text has no words.  Rows without an id are never changed and change no other
row.  Rows that repeat an id count as one document, so neither removes words of the other
(they are told apart by 16 bits of a hash of their text).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed, ship, tidied

WINDOW = 13
SEED_WORDS = 2
FLUSH_BYTES = 12 << 20
BUCKET_BYTES = 64 << 20
BUCKETS_PER_PARTITION = 4
_ROW = np.dtype([("key", "<u4"), ("place", "<i8"), ("doc", "<i8")])


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes split at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_mark(text: str | None) -> int:
    """Sixteen bits that tell apart rows with one id."""
    return xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) & 0xFFFF


def minimisers(words: list[bytes], window: int) -> np.ndarray:
    """Minimiser of each window."""
    n = len(words)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    grams = hashes[: n - SEED_WORDS + 1].copy()
    for i in range(1, SEED_WORDS):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - SEED_WORDS + 1 + i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return np.lib.stride_tricks.sliding_window_view(grams, window - SEED_WORDS + 1).min(axis=1)


def super_kmers(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Minimiser, first window and packed words of each run of windows."""
    least = minimisers(words, window)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] + window - 2  # last word of each run
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined = b" ".join(words)
    begin, stop = np.r_[0, ends][first].tolist(), (ends[last] - 1).tolist()
    return least[first], first, [joined[a:b] for a, b in zip(begin, stop)]


def _columns_first(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), _ROW.itemsize).T).tobytes()


def _pack(rows: np.ndarray, strings: list[bytes]) -> bytes:
    head = len(rows).to_bytes(4, "little") + _columns_first(rows)
    return zstandard.ZstdCompressor(level=3).compress(head + b"\n".join(strings))


def _unpack(block: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:4], "little")
    end = 4 + n * _ROW.itemsize
    flat = np.frombuffer(data, np.uint8, n * _ROW.itemsize, 4).reshape(_ROW.itemsize, n).T
    return np.ascontiguousarray(flat).view(_ROW).ravel(), data[end:].split(b"\n")


class _Packer:
    """Collects super-k-mers of a task and sends them out by bucket."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.clear()

    def clear(self) -> None:
        self.size, self.keys, self.rows, self.strings = 0, [], [], []

    def add(self, doc: int, text: str | None) -> None:
        words = words_of(text)
        if len(words) < self.window:
            return
        keys, starts, strings = super_kmers(words, self.window)
        rows = np.empty(len(keys), _ROW)
        rows["key"] = keys >> np.uint64(32)
        rows["place"] = starts << 16 | text_mark(text)
        rows["doc"] = doc
        self.keys.append(keys)
        self.rows.append(rows)
        self.strings += strings
        self.size += sum(map(len, strings))

    def flush(self) -> Iterator[tuple]:
        """Rows (bucket, block, bytes) and, for strings settled here, (doc, place, windows)."""
        if not self.rows:
            return
        keys, rows, strings = np.concatenate(self.keys), np.concatenate(self.rows), self.strings
        self.clear()
        order = np.lexsort((rows["doc"], keys))
        same = np.r_[False, keys[order][1:] == keys[order][:-1]]
        repeated = np.zeros(len(keys), bool)
        repeated[order] = same | np.r_[same[1:], False]
        alive = np.ones(len(keys), bool)
        first: dict[bytes, int] = {}
        for i in order[repeated[order]].tolist():
            owner = first.setdefault(strings[i], int(rows["doc"][i]))
            if owner < rows["doc"][i]:
                alive[i] = False
                windows = strings[i].count(b" ") + 2 - self.window
                yield None, None, 0, int(rows["doc"][i]), int(rows["place"][i]), windows
        order = order[alive[order]]
        bucket = (keys[order] % np.uint64(self.buckets)).astype(np.int64)
        order, bucket = order[(by := np.argsort(bucket, kind="stable"))], bucket[by]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            chosen = [strings[i] for i in order[a:b].tolist()]
            yield int(bucket[a]), _pack(rows[order[a:b]], chosen), sum(map(len, chosen)), None, None, None


def _settle(blocks: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """(doc, place, windows) of runs of windows that a smaller id has, in one bucket."""
    parts = [_unpack(b) for b in blocks]
    rows = np.concatenate([p[0] for p in parts])
    strings = [s for p in parts for s in p[1]]
    order = np.lexsort((rows["doc"], rows["key"]))
    keys, docs = rows["key"][order], rows["doc"][order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.r_[begin[1:], len(keys)]
    shared = docs[begin] != docs[end - 1]  # a minimiser of one document settles nothing
    for a, b in zip(begin[shared].tolist(), end[shared].tolist()):
        owner: dict[bytes, int] = {}
        for i in order[a:b].tolist():
            doc, place, packed = int(rows["doc"][i]), int(rows["place"][i]), strings[i]
            ends = [j for j, c in enumerate(packed) if c == 32]
            begins = [0, *[j + 1 for j in ends]]
            ends.append(len(packed))
            run = 0
            for number in range(len(begins) - window + 1):
                one = packed[begins[number] : ends[number + window - 1]]
                if owner.setdefault(one, doc) < doc:
                    run += 1
                elif run:
                    yield doc, place + (number - run << 16), run
                    run = 0
            if run:
                yield doc, place + (len(begins) - window + 1 - run << 16), run


def _record(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _in_batches(rows: Iterator[tuple], names: list[str], types: list, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") if weight is not None else 0
        if len(held) >= 20_000 or size >= 4 << 20:
            yield _record(names, types, held)
            held, size = [], 0
    if held:
        yield _record(names, types, held)


def repeated_runs(docs: DataFrame, id_col: str, text: str, window: int = WINDOW) -> DataFrame:
    """``(doc, place, windows)``: runs of windows that also start in a document with a smaller id.

    ``place`` is the first window's word number times 65536 plus the row's text mark.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["bucket", "block", "size", "doc", "place", "windows"]
    schema = "bucket bigint, block binary, size bigint, doc bigint, place bigint, windows bigint"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, window)

        def rows():
            for batch in batches:
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    packer.add(doc, value.as_py())
                    if packer.size >= FLUSH_BYTES:
                        yield from packer.flush()
            yield from packer.flush()

        return _in_batches(rows(), names, kinds, weight=1)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            bucket, blocks, size, large = None, [], 0, False

            def close():
                if large:
                    yield from ((None, b, 0, None, None, None) for b in blocks)
                else:
                    yield from ((None, None, 0, *run) for run in _settle(blocks, window))

            for batch in batches:
                for number, block, raw, *run in zip(*(c.to_pylist() for c in batch.columns)):
                    if block is None:
                        yield None, None, 0, *run
                        continue
                    if number != bucket:
                        if blocks:
                            yield from close()
                        bucket, blocks, size, large = number, [], 0, False
                    blocks.append(block)
                    size += raw
                    if size > BUCKET_BYTES:
                        large = True
                        yield from close()
                        blocks = []
            if blocks:
                yield from close()

        return _in_batches(rows(), names, kinds, weight=1)

    sent = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("bigint").alias("doc"), docs[text].alias("text"))
    # Settled runs have no bucket; their place spreads them out.
    dealt = sent.mapInArrow(tidied(send), schema).repartition(F.coalesce("bucket", F.xxhash64("doc", "place"))).sortWithinPartitions("bucket")
    found = landed(dealt.mapInArrow(tidied(settle), schema), "runs")
    runs = found.where("block is null").select("doc", "place", "windows")
    open_blocks = found.where("block is not null").select("block")
    if not open_blocks.isEmpty():
        runs = runs.unionByName(_hot_runs(open_blocks, window))
    return runs


def _hot_runs(blocks: DataFrame, window: int) -> DataFrame:
    """Runs of one window each for buckets that are too large for one task."""
    names, kinds = ["high", "low", "doc", "place"], [pa.int64()] * 4

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    for row, packed in zip(*_unpack(block)):
                        words = packed.split(b" ")
                        for i in range(len(words) - window + 1):
                            digest = xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                            yield (
                                int.from_bytes(digest[:8], "big", signed=True),
                                int.from_bytes(digest[8:], "big", signed=True),
                                int(row["doc"]),
                                int(row["place"]) + (i << 16),
                            )

        return _in_batches(rows(), names, kinds)

    windows = blocks.repartition(F.xxhash64("block")).mapInArrow(tidied(spread), "high bigint, low bigint, doc bigint, place bigint")
    least = windows.groupBy("high", "low").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return windows.join(least, ["high", "low"]).where("doc > least").select("doc", "place", F.lit(1).cast("bigint").alias("windows"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` less its repeated words, and ``n_words`` and ``n_removed``.

    A text that loses nothing stays as it is, white space included; else its kept words are
    joined by single spaces.  Existing columns of the two names are replaced.
    """
    places = repeated_runs(docs.select(id_col, text), id_col, text, window)
    by_doc = places.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("place", "windows")).alias("__runs"))
    base = docs.drop("n_words", "n_removed")
    # The runs grow with the input, although their files compress to little: never sent to all tasks.
    joined = base.join(by_doc.hint("merge"), docs[id_col].cast("bigint") == by_doc["__doc"], "left").drop("__doc")
    at = base.columns.index(text)
    schema = joined.drop("__runs").withColumn("n_words", F.lit(0).cast("bigint")).withColumn("n_removed", F.lit(0).cast("bigint")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for value, runs in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value, runs = value.as_py(), runs.as_py()
                words = words_of(value)
                gone = np.zeros(len(words) + 1, np.int64)
                mark = text_mark(value) if runs else 0
                for run in runs or ():
                    if run["place"] & 0xFFFF == mark:
                        start = run["place"] >> 16
                        gone[start] += 1
                        gone[start + run["windows"] + window - 1] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                n = int(covered.sum())
                if n:
                    value = b" ".join(words[i] for i in np.flatnonzero(~covered)).decode("utf-8", "surrogatepass")
                texts.append(value)
                totals.append(len(words))
                removed.append(n)
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "n_removed"])

    return joined.mapInArrow(tidied(apply), schema)
