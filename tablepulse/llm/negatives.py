"""Hard negatives by the threshold algorithm over sorted lists per dimension.

Rows are dealt into shards by hash.  A shard lists its rows per dimension in order of the
component.  An anchor reads each list from the end that its own component's sign prefers
(sorted access, some places of all lists at a time) and scores every row it meets there in
full (random access, integers).  No row not yet met can score more than the *threshold*, the
score that the last components read would make; the anchor stops once that is strictly below
the k-th score of each of its windows (ranges of scores), or below the window.  Equal
thresholds go on, as ties go to the smaller id.

Two searches use it: the positives of an anchor (one window without limits, its own label),
then the negatives (a window per positive, other labels).  Each search visits one shard per
anchor first and takes its k-th scores as lower limits to all others.

All anchors must meet all shards, but only as blocks: a shard is sent once per
``CHUNK_ANCHORS`` anchors, which stream past it, so a task holds one shard.

Rows: those without id, label or vector, with an empty vector or with a NULL or non-finite
component take no part, and vectors only meet vectors of their length.  Rows equal in id, label and vector
count once; rows that share an id but differ take part each for itself, and none is a
partner of its own id.  Scores are exact: in floating point where all sums stay below 2**53,
else in whole numbers of any size; a score that does not fit a long raises an error.
Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed, ship

SHARD_ROWS = 16_384
CHUNK_ANCHORS = 4_096
MAX_TASKS = 8_192
FIRST_PLACES = 32
LEAST, MOST = -(2**63), 2**63 - 1
WINDOWS = "array<struct<tag:bigint,low:bigint,high:bigint>>"
FOUND = "id bigint, mark bigint, tag bigint, other bigint, other_mark bigint, score bigint"


def scaled(vectors: DataFrame, id_col: str, vector: str, label: Column, scale: float) -> DataFrame:
    """``(id, mark, label, v)`` of the rows that take part; components are ``floor(scale * x)``.

    ``mark`` tells apart rows of one id.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    x = F.col("x")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    # floor of a double is a bigint in Spark, so components that exceed it are kept as they are (whole numbers already).
    whole = F.transform(
        x, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**53, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale)
    )
    rows = rows.where((F.size(x) > 0) & finite).select("id", "label", whole.alias("v"))
    return rows.distinct().withColumn("mark", F.xxhash64("label", "v"))


class Lists:
    """The rows of a shard, listed per dimension by rising component."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.marks, self.labels, self.vectors = ids, marks, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.largest = float(np.abs(vectors).max(initial=0))
        self._whole = None

    def exact(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and an anchor in numbers whose products and sums are exact."""
        if self.largest * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
            return self.vectors, q
        if self._whole is None:
            self._whole = np.array([[int(c) for c in row] for row in self.vectors], object)
        return self._whole, np.array([int(c) for c in q], object)


def walk(lists: Lists, q: np.ndarray, own_id: int, own_label: int, windows: list[tuple[int, int]], k: int, same: bool):
    """The ``k`` best rows of a shard in each window ``(low, high)``: per window (scores, rows).

    Rows of the anchor's label take part if ``same``, the others if not; ties go to the smaller id.
    """
    vectors, q = lists.exact(q)
    n = len(lists.ids)
    live = np.flatnonzero(q != 0)
    down = (q[live] > 0)[:, None]
    seen = np.zeros(n, bool)
    held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    depth, places = 0, FIRST_PLACES
    # Without a component all scores are 0, as the threshold is: every row is met at once.
    if not len(live):
        depth, places = n, 0
    while True:
        stop = min(n, depth + places)
        if len(live):
            at = np.arange(depth, stop)
            met = lists.order[live[:, None], np.where(down, n - 1 - at, at)]
            new = np.zeros(n, bool)
            new[met.ravel()] = True
            new &= ~seen
            seen |= new
            threshold = (q[live] * vectors[met[:, -1], live]).sum()
        else:
            new, threshold = ~seen, 0
        rows = np.flatnonzero(new)
        rows = rows[((lists.labels[rows] == own_label) == same) & (lists.ids[rows] != own_id)]
        scores = vectors[rows] @ q
        if len(scores) and scores.dtype == object and max(map(abs, scores)) > MOST:
            raise OverflowError("a score does not fit a long")
        scores = scores.astype(np.int64)
        ended = True
        for i, (low, high) in enumerate(windows):
            good = (scores >= low) & (scores <= high)
            if good.any():
                all_scores, all_rows = np.r_[held[i][0], scores[good]], np.r_[held[i][1], rows[good]]
                first = np.lexsort((lists.marks[all_rows], lists.ids[all_rows], -all_scores))[:k]
                held[i] = all_scores[first], all_rows[first]
            least = max(low, int(held[i][0][-1])) if len(held[i][0]) == k else low
            ended &= bool(threshold < least)
        if ended or stop == n:
            return held
        depth, places = stop, 2 * places


def _searched(pairs: DataFrame, tasks: int, k: int, same: bool) -> DataFrame:
    """Best rows of each anchor's windows in each shard of ``pairs``.

    ``pairs (shard, chunk, is_anchor, id, mark, label, v, windows)`` holds the rows of a shard once
    per chunk, and the anchors that visit it.
    """
    names = [part.split()[0] for part in FOUND.split(", ")]

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids, marks, labels = (batch.column(i).to_numpy() for i in (3, 4, 5))
        return ids, marks, labels, batch.column(6).flatten().to_numpy().reshape(len(ids), -1)

    def visits(batch: pa.RecordBatch, lists: Lists) -> pa.RecordBatch:
        out = [[] for _ in names]
        for own_id, mark, label, q, windows in zip(*numbers(batch), batch.column(7).to_pylist()):
            found = walk(lists, q, own_id, label, [(w["low"], w["high"]) for w in windows], k, same)
            for window, (scores, rows) in zip(windows, found):
                more = [own_id] * len(rows), [mark] * len(rows), [window["tag"]] * len(rows), lists.ids[rows], lists.marks[rows], scores
                for column, values in zip(out, more):
                    column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, lists = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if tuple(keys[:2, a]) != key:
                    key, parts, lists = tuple(keys[:2, a]), [], None
                part = batch.slice(a, b - a)
                if not keys[2, a]:
                    parts.append(numbers(part))
                    continue
                if lists is None and parts:
                    lists, parts = Lists(*(np.concatenate(c) for c in zip(*parts))), []
                if lists is not None:
                    yield visits(part, lists)

    dealt = pairs.repartition(tasks, "shard", "chunk").sortWithinPartitions("shard", "chunk", "is_anchor")
    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "mark", "tag").orderBy(F.desc("score"), "other", "other_mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, anchors: DataFrame, k: int, same: bool, shard_rows: int = SHARD_ROWS, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """``(id, mark, tag, other, other_mark, score, rank)``: the ``k`` best rows in each window of each anchor.

    ``anchors (id, mark, label, v, windows)`` are rows with their windows (tag, low, high).
    """
    shards = max(1, -(-rows.count() // shard_rows))
    chunks = max(1, -(-anchors.count() // chunk_anchors))
    tasks = min(shards * chunks, MAX_TASKS)
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.lit(n)).cast("int")
    size = F.size("v")
    # Lengths do not mix: a shard holds rows of one length.
    key = lambda number: F.struct(size.alias("dim"), number.alias("number"))
    blank = F.lit(None).cast(WINDOWS)
    columns = ["shard", "chunk", "is_anchor", "id", "mark", "label", "v", "windows"]
    placed = rows.withColumns({"number": spread(shards, 1), "windows": blank, "is_anchor": F.lit(False)})
    visitors = anchors.withColumns({"home": spread(shards, 2), "chunk": spread(chunks, 3), "is_anchor": F.lit(True)})

    def meet(visits: DataFrame) -> DataFrame:
        copies = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        both = copies.withColumn("shard", F.xxhash64(key(F.col("number")))).select(*columns).unionByName(
            visits.withColumn("shard", F.xxhash64(key(F.col("number")))).select(*columns)
        )
        return _searched(both, tasks, k, same)

    first = landed(meet(visitors.withColumn("number", F.col("home"))), "first_shard")
    if shards == 1:
        return _best(first, k)
    bars = first.groupBy("id", "mark", "tag").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") == k)
    bars = bars.groupBy("id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("tag", "bar"))).alias("bars"))
    raised = F.transform(
        "windows", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at("bars", w["tag"]), w["low"])))
    )
    others = visitors.join(bars, ["id", "mark"], "left").withColumn("windows", raised)
    others = others.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("number") != F.col("home"))
    return _best(first.unionByName(meet(others)), k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, shard_rows: int = SHARD_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on the column ``id``.  Negatives of a positive have other labels and
    ``low`` to ``high`` percent of its score.  Ranks are from 1.
    """
    ship(vectors.sparkSession)
    label = F.col("label") if label is None else label
    rows = landed(scaled(vectors, id_col, vector, label, scale), "scaled")
    anchors = rows.where(is_anchor)
    all_scores = F.array(F.struct(F.lit(0).cast("bigint").alias("tag"), F.lit(LEAST).cast("bigint").alias("low"), F.lit(MOST).cast("bigint").alias("high")))
    found = search(rows, anchors.withColumn("windows", all_scores), positives, True, shard_rows, chunk_anchors)
    found = landed(found.select("id", "mark", F.col("rank").cast("bigint").alias("tag"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Percent of a score in whole numbers; a product with 100 may exceed a bigint.
    part = lambda percent: F.col("positive_score").cast("decimal(38,0)") * percent / 100
    window = F.struct("tag", F.ceil(part(low)).cast("bigint").alias("low"), F.floor(part(high)).cast("bigint").alias("high"))
    windows = found.groupBy("id", "mark").agg(F.filter(F.collect_list(window), lambda w: w["low"] <= w["high"]).alias("windows"))
    ranged = anchors.join(windows.where(F.size("windows") > 0), ["id", "mark"])
    negatives = search(rows, ranged, k, False, shard_rows, chunk_anchors)
    return negatives.join(found, ["id", "mark", "tag"]).select(
        F.col("id").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
