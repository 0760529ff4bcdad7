"""Text records that may run over several lines, read in as many tasks as the files have splits.

A split is the byte range of a file that one task reads, so a task cannot know from its lines
alone whether it starts inside a quoted text.  Each line is therefore taken as a function
of that: for a start outside and a start inside of quotes it says where the line ends.
Such functions compose, so a first scan brings one function per split to the driver, which
already lists the splits to plan the scan.  A second scan is joined with every split's start:
records that end in their split are put together there, and only the pieces of those that do
not are brought together, by the line that opens them.

The lines of the splits before are counted on the way, so every record also gets its line
number in the file.  It does not depend on how the file is split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW_NO = "_file", "_row_no"
# A quoted text that opens at the start of a field and closes in the same line.
CLOSED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
OPENED = r'(^|,)"'
# What is left of a quoted text that was opened in an earlier line, with its closing quote.
CLOSING = r'^[^"]*+(?:""[^"]*+)*+"(?!")'
SEGMENTS = "file string, start bigint, lines bigint, after_outside boolean, after_inside boolean, opener_outside bigint, opener_inside bigint"
STARTS = "file string, start bigint, first bigint, inside boolean, opener bigint"
# Small splits share a task: a core gets so many tasks at least, and a task so many bytes at most.
TASKS_PER_CORE, TASK_BYTES = 32, 32 << 20
PLACED = "file string, row_no bigint, whole boolean, value string, line bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, value, after_outside, after_inside)`` of every line; splits are told apart by ``start``."""
    text = spark.read.text(path, lineSep="\n")
    lines = text.coalesce(_tasks(spark, text.rdd.getNumPartitions())).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quoted = F.contains("value", F.lit('"'))
    rest = F.regexp_replace("value", CLOSING, "")
    closes = F.col("value").rlike(CLOSING)
    return lines.select(
        "*",
        (quoted & _ends_inside(F.col("value"))).alias("after_outside"),
        # After its closing quote a field goes on to the next comma, so a quote there opens nothing.
        (~quoted | ~closes | _ends_inside(F.concat(F.lit("x"), rest))).alias("after_inside"),
    )


def _tasks(spark: SparkSession, splits: int) -> int:
    """Tasks that read so many splits: one each, unless there are many small ones."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    size = int(number) * 1024 ** " kmgtp".index(unit or " ")
    return max(1, min(splits, max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, splits * size // TASK_BYTES)))


def _ends_inside(text: Column) -> Column:
    return F.regexp_replace(text, CLOSED, "$1x").rlike(OPENED)


def _states(after_outside: np.ndarray, after_inside: np.ndarray, begin: bool) -> np.ndarray:
    """Whether the reader is inside quotes after each line, for a start inside (``begin``) or outside."""
    n = np.arange(len(after_outside))
    fixed = after_outside == after_inside
    swaps = np.cumsum(after_outside & ~after_inside)
    last = np.maximum.accumulate(np.where(fixed, n, -1))
    known = last >= 0
    base = np.where(known, after_outside[last], begin)
    return base ^ ((swaps - np.where(known, swaps[last], 0)) % 2 == 1)


@dataclass
class _Split:
    """What has been read of a split so far, from one start."""

    inside: bool
    opener: int = -1  # line that opened the text that is open now; -1: a line of an earlier split
    line: int = 0

    def read(self, after_outside: np.ndarray, after_inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per line: inside quotes before it, after it, and the line that opened its record."""
        after = _states(after_outside, after_inside, self.inside)
        before = np.r_[self.inside, after[:-1]]
        number = self.line + np.arange(len(after))
        opened = np.maximum.accumulate(np.r_[self.opener, np.where(before, -1, number)])[1:]
        if len(after):
            self.inside, self.line = bool(after[-1]), self.line + len(after)
            self.opener = int(opened[-1])
        return before, after, opened


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch that belong to one split, with its file and start."""
    if not batch.num_rows:
        return
    starts = batch.column(1).to_numpy()
    codes = batch.column(0).dictionary_encode()
    files = codes.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield (codes.dictionary[int(files[a])].as_py(), int(starts[a])), batch.slice(a, b - a)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each split, and the line that opens the text left open at its end."""
    names = [part.split()[0] for part in SEGMENTS.split(", ")]
    key, both = None, ()

    def close() -> pa.RecordBatch:
        outside, inside = both
        row = [*key, outside.line, outside.inside, inside.inside, outside.opener, inside.opener]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for found, part in _runs(batch):
            if found != key:
                if key:
                    yield close()
                key, both = found, (_Split(False), _Split(True))
            for state in both:
                state.read(*_flags(part))
    if key:
        yield close()


def _starts(segments: list) -> list[tuple[str, int, int, bool, int]]:
    """Per split the lines before it, whether it starts inside quotes, and the line that opened that text."""
    found, file = [], None
    for s in sorted(segments, key=lambda s: (s["file"], s["start"])):
        if s["file"] != file:
            file, line, inside, opener = s["file"], 0, False, -1
        found.append((file, s["start"], line, inside, opener))
        own = s["opener_inside"] if inside else s["opener_outside"]
        opener = line + own if own >= 0 else opener
        inside = s["after_inside"] if inside else s["after_outside"]
        line += s["lines"]
    return found


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and pieces of those that run over the end of a split, each with the number of its first line.

    Every line carries the start of its split.
    """
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in PLACED.split(", ")]
    key, state, first, held = None, None, 0, []  # held: texts of the record that is open, from line ``first_held`` on
    first_held = 0

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[key[0]] * len(found), *columns], kinds)], names)

    for batch in batches:
        for found, part in _runs(batch):
            if found != key:
                if held:
                    yield rows([(state.opener, False, "\n".join(held), first_held)])
                key, held = found, []
                first, inside, opener = (part.column(i)[0].as_py() for i in (5, 6, 7))
                if first is None:
                    raise ValueError(f"{key[0]} was split otherwise when it was scanned for quotes")
                state = _Split(inside, opener, first)
            line = state.line
            before, after, opened = state.read(*_flags(part))
            if not held and not (before | after).any():
                number = pa.array(line + np.arange(len(before)))
                yield pa.RecordBatch.from_arrays([part.column(0), number, pa.array(~before), part.column(2), number], names)
                continue
            texts, out = part.column(2).to_pylist(), []
            ends = np.flatnonzero(~after).tolist()
            for a, b in zip([0, *(e + 1 for e in ends)], [*(e + 1 for e in ends), len(texts)]):
                if a == b:
                    continue
                first_held = first_held if held else line + a
                held += texts[a:b]
                if not after[b - 1]:
                    out.append((int(opened[b - 1]), bool(opened[b - 1] >= first), "\n".join(held), first_held))
                    held = []
            yield rows(out)
    if held:
        yield rows([(state.opener, False, "\n".join(held), first_held)])


def records(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """``(_file, _row_no, value)``: the records of a text file or folder, with the number of their first line.

    With ``quoted``, a record ends at the first line end outside of quotes, as CSV writes them; otherwise
    every line is one.  The text is scanned twice, and once more where a record runs over the end of a split.
    Lines end with a line feed; a carriage return at the end of a record is dropped.
    """
    lines = _lines(spark, path)
    if not quoted:
        lines = lines.withColumns({"after_outside": F.lit(False), "after_inside": F.lit(False)})
    bare = lines.withColumn("value", F.lit(None).cast("string"))
    # One row per split, of which the driver holds a list anyway.
    segments = bare.mapInArrow(_segments, SEGMENTS).collect()
    starts = _starts(segments)
    # Broadcast once per executor: as many rows as splits, which no task takes along whole.
    known = F.broadcast(spark.createDataFrame(starts, STARTS))
    placed = lines.join(known, ["file", "start"], "left").mapInArrow(_placed, PLACED)
    found = placed.where("whole").select("file", "row_no", "value")
    # Without a split that starts or ends inside of quotes there are no pieces.
    inside = {(file, start): inside for file, start, _, inside, _ in starts}
    if any(s["after_inside" if inside[s["file"], s["start"]] else "after_outside"] for s in segments):
        in_order = F.array_sort(F.collect_list(F.struct("line", "value")))
        joined = placed.where("not whole").groupBy("file", "row_no").agg(F.array_join(in_order["value"], "\n").alias("value"))
        found = found.unionByName(joined)
    return found.select(F.col("file").alias(FILE), F.col("row_no").alias(ROW_NO), F.regexp_replace("value", "\r$", "").alias("value"))
