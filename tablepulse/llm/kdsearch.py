"""Exact top-k inner products by KD-trees per shard.

Candidates are dealt into shards by hash.  A shard keeps each distinct vector once, with its
``k + 1`` smallest ids (more can never be answered), and builds a tree by median splits of
the widest side, with the tight box of every node.  Queries come in blocks.  A query walks a
tree best first: the node with the largest bound ``sum(max(q * low, q * high))`` over its box
is opened next, until that bound is below the query's k-th score.  Equal bounds are opened
too, since ties go to the smaller id.  Every block searches one shard first and carries its
k-th scores to all others.

All queries must meet all shards, but only as blocks: a task holds one tree and one block.

Rows: vectors that are NULL or hold NULL or non-finite components take no part.  Scores are
exact; where they might not fit a long (sums of 2**62 or more), the search fails with an
error.  Vectors only meet vectors
of their length; empty ones take no part.  Rows that repeat id and vector count once.  An id
with several vectors stands for each of them, with its best score.  Rows without an id take
no part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed, ship

SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
LEAF = 256
LOWEST = -(2**63) + 1  # can be negated


def scaled(vectors: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """``(id, v, dim)`` of the vectors that take part; components are ``floor(scale * x)``."""
    x = F.col(vector)
    fits = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fits)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"), F.size(x).alias("dim")).distinct()


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def build_tree(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Arrays of a tree: points in leaf order with their ids, and per node box, range and children."""
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.lexsort((ids, which))
    which, ids = which[order], ids[order]
    nth = np.arange(len(which)) - np.searchsorted(which, which)
    which, ids = which[nth <= k], ids[nth <= k]
    low, high, start, stop, child = [], [], [], [], []
    place = np.arange(len(points))
    todo = [(0, len(points), -1)]
    while todo:
        a, b, parent = todo.pop()
        here = points[place[a:b]]
        node = len(start)
        low.append(here.min(axis=0))
        high.append(here.max(axis=0))
        start.append(a)
        stop.append(b)
        child.append(-1)
        if parent >= 0 and child[parent] < 0:
            child[parent] = node
        if b - a > LEAF:
            side = int((high[-1] - low[-1]).argmax())
            middle = (b - a) // 2
            place[a:b] = place[a:b][np.argpartition(here[:, side], middle)]
            # The second child is numbered right after the first one's subtree; both are linked below.
            todo += [(a + middle, b, node), (a, a + middle, node)]
    start, stop, child = np.array(start), np.array(stop), np.array(child)
    other = np.full(len(start), -1)
    second = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(start, stop))}
    for node in np.flatnonzero(child >= 0).tolist():
        other[node] = second[(int(stop[child[node]]), int(stop[node]))]
    rank = np.empty(len(points), np.int64)
    rank[place] = np.arange(len(points))
    mine = rank[which]
    order = np.lexsort((ids, mine))
    return {
        "points": points[place], "ids": ids[order], "owner": mine[order], "low": np.array(low), "high": np.array(high),
        "start": start, "stop": stop, "child": child, "other": other,
    }


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row by falling score, then rising id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: dict[str, np.ndarray], own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best ``k`` in one tree (LOWEST where there are fewer).

    Candidates below ``kth`` need not be found.
    """
    sizes = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (tree["low"], tree["high"], queries)]
    largest = max(sizes[:2]) * sizes[2] * queries.shape[1]
    if largest >= 2**62:
        raise OverflowError("a score may not fit a long")
    exact = np.float64 if largest < 2**53 else np.int64
    points, low, high, q = (a.astype(exact) for a in (tree["points"], tree["low"], tree["high"], queries))
    n = len(q)
    scores, ids = np.full((n, k), LOWEST), np.full((n, k), np.iinfo(np.int64).max)
    kth = kth.copy()

    def bounds(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(who), np.int64)
        for at in range(0, len(who), 4096):
            some = q[who[at : at + 4096]]
            out[at : at + 4096] = np.maximum(some * low[nodes[at : at + 4096]], some * high[nodes[at : at + 4096]]).sum(axis=1)
        return out

    first = np.searchsorted(tree["owner"], np.arange(len(points) + 1))
    open_ = np.full((n, len(low)), LOWEST)
    open_[:, 0] = bounds(np.arange(n), np.zeros(n, np.int64))
    active = np.arange(n)
    while len(active):
        node = open_[active].argmax(axis=1)
        bound = open_[active, node]
        go = (bound > LOWEST) & (bound >= kth[active])
        active, node = active[go], node[go]
        open_[active, node] = LOWEST
        inner = tree["child"][node] >= 0
        for link in ("child", "other"):
            at, to = active[inner], tree[link][node[inner]]
            open_[at, to] = bounds(at, to)
        at, leaves = active[~inner], node[~inner]
        for leaf in np.unique(leaves).tolist():
            who = at[leaves == leaf]
            a, b = tree["start"][leaf], tree["stop"][leaf]
            made = (q[who] @ points[a:b].T).astype(np.int64)
            some = slice(first[a], first[b])
            good = made.max(axis=1) >= kth[who]
            if not good.any():
                continue
            who, made = who[good], made[good]
            found, listed = made[:, tree["owner"][some] - a], np.broadcast_to(tree["ids"][some], (len(who), some.stop - some.start))
            found = np.where(listed == own[who, None], LOWEST, found)
            scores[who], ids[who] = _merge(np.c_[scores[who], found], np.c_[ids[who], listed], k)
            kth[who] = np.maximum(kth[who], scores[who, k - 1])
    return scores, ids


def _packed(rows: DataFrame, number: Column, pack) -> DataFrame:
    """``(dim, number, payload)``: the rows of one number packed by ``pack(ids, vectors)``."""
    ordered = rows.withColumn("number", number.cast("int")).select("dim", "number", "id", "v")
    ordered = ordered.repartition("dim", "number").sortWithinPartitions("dim", "number", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close():
            ids = np.concatenate([b.column(2).to_numpy() for b in held])
            flat = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
            payload = pack(ids, flat.reshape(len(ids), key[0]))
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "number", "payload"])

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if tuple(keys[:, a].tolist()) != key:
                    if held:
                        yield close()
                    held, key = [], tuple(keys[:, a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return ordered.mapInArrow(run, "dim int, number int, payload binary")


def _searched(pairs: DataFrame, k: int, carry: bool) -> DataFrame:
    """Best candidates of each pair of block and tree; with ``carry`` also the block with its k-th scores."""
    schema = "query_id bigint, vec_id bigint, score bigint, dim int, block int, payload binary"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            for dim, number, block, payload, content in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (dim, number):
                    shard, tree = (dim, number), _load(content)
                queries = _load(payload)
                scores, ids = search(tree, queries["ids"], queries["vectors"], queries["kth"], k)
                real = (scores > LOWEST) & (scores >= queries["kth"][:, None])
                own = np.broadcast_to(queries["ids"][:, None], ids.shape)
                n = int(real.sum())
                blank = [pa.nulls(n, t) for t in kinds[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(own[real]), pa.array(ids[real]), pa.array(scores[real]), *blank], names)
                if carry:
                    bound = np.maximum(queries["kth"], scores[:, k - 1])
                    data = _dump(**(queries | {"kth": bound}))
                    row = [[None], [None], [None], [dim], [block], [data]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

    ordered = pairs.select("dim", "number", "block", "payload", "content").sortWithinPartitions("dim", "number")
    return ordered.mapInArrow(run, schema)


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest integer inner products of each query row with all others.

    ``is_query`` is a condition on the column ``id``.  Ranks are from 1, ties go to the smaller id.
    """
    ship(vectors.sparkSession)
    rows = landed(scaled(vectors, id_col, vector, scale), "scaled")
    shards = max(1, -(-rows.count() // shard_rows))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // block_queries))

    def pack_tree(ids: np.ndarray, found: np.ndarray) -> bytes:
        return _dump(**build_tree(ids, found, k))

    def pack_block(ids: np.ndarray, found: np.ndarray) -> bytes:
        return _dump(ids=ids, vectors=found, kth=np.full(len(ids), LOWEST))

    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    trees = landed(_packed(rows, spread(shards), pack_tree).withColumnRenamed("payload", "content"), "trees")
    packed = _packed(queries, spread(blocks), pack_block).withColumnRenamed("number", "block")
    home = F.pmod("block", F.lit(shards)).cast("int")
    one = landed(_searched(packed.withColumn("number", home).join(trees, ["dim", "number"]), k, True), "first_search")
    # Lengths that are missing in a block's first shard meet the other shards without a bound.
    lost = packed.withColumn("number", home).join(trees, ["dim", "number"], "left_anti").select("dim", "block", "payload")
    carried = one.where("payload is not null").select("dim", "block", "payload").unionByName(lost)
    others = carried.select("dim", "block", "payload", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("number"))
    others = others.where(F.col("number") != home)
    rest = _searched(others.join(trees, ["dim", "number"]), k, False)
    found = one.where("query_id is not null").unionByName(rest).select("query_id", "vec_id", "score")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
