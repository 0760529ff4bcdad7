"""SimHash near duplicates through an inverted index over fingerprint bytes.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ in at most
``max_bits`` bits share at least ``8 - max_bits`` of them: the guaranteed number of matches.
The index keys its postings by sets of positional bytes, chosen so that every pair with the
guaranteed matches meets in at least one posting (single bytes would put 1/256 of all rows
into a posting).  Inside a posting the shared positional bytes of each pair are tallied,
pairs below the guaranteed number are dropped and the rest is verified by bit distance.
Only a spanning forest of the verified pairs leaves a posting, never all pairs.

``similar_groups`` also finds less alike texts: postings are then shingles of the prefixes of
their sets, in one order for all texts, 256 parity bits drop candidates that cannot be alike, and
what is left is verified by the exact Jaccard similarity of the sets of shingles.  Neither loses a pair.

Rows: a NULL text has no words.  A text without words has fingerprint zero and is linked
like any other.  NULL ids keep their fingerprint; a component is named by its smallest
non-NULL id (NULL if it has none).  Repeated rows stay repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.components import components
from tablepulse.llm.pieces import slices
from tablepulse.llm.storage import cut, landed, ship, tidied

POSTING_ROWS = 4096  # above this, a posting is solved in parts
SEED = 42  # fixed value: seed of the shingle hash
WIDE = 4  # 64-bit words of the parity bits of a part
PART = 400  # shingles above which a set is dealt into parts; more would fill the parity bits
SHORT = 64  # texts below so many shingles are not judged by bits
BLOCK_SHINGLES = 1 << 18  # shingles of a block of sets that are compared at once
ORDER_TEXTS = 20_000  # about so many texts tell which shingles are common
ORDER_SHINGLES = 100_000  # common shingles that are ordered by their number of texts

# Bits of each byte value, highest first, repeated for the eight positions.
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Big-endian XXH64 digests, one row of eight bytes per shingle, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty((0, 8), np.uint8)
    if len(parts) <= words:
        digests = [xxhash.xxh64_digest(b" ".join(parts), SEED)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[:-1].tolist()]
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)


def fingerprint_of(digests: np.ndarray) -> int:
    """Majority vote per bit, as a signed 64-bit number."""
    n = len(digests)
    if not n:
        return 0
    places = digests.astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big", signed=True)


def parity_words(values: np.ndarray) -> list[int]:
    """``64 * WIDE`` bits: whether an odd number of the hashes falls in each place.

    Each hash that only one of two sets has turns one bit, so the sets differ in at least as
    many hashes as bits.
    """
    odd = np.bincount((values % np.uint64(64 * WIDE)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, words).view(">u8").ravel().astype(np.uint64))


def prefix_keys(values: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set: two sets of this Jaccard similarity share one of theirs.

    Shingles that are not ``common`` come first, by hash, then the common ones by rank.  Any
    order has that property if it is the same for all sets.
    """
    n = len(values)
    if not n:
        return np.zeros(1, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        values = values[np.lexsort((values, np.where(common[at] == values, ranks[at], 0)))]
    return values[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)


def set_parts(values: np.ndarray, similarity: float) -> list[tuple[int, int, np.ndarray]]:
    """``(level, number, part)``: the parts of a set of hashes that are compared with those of other sets.

    A level deals hashes into ``2**level`` parts of up to some ``PART``.  The shared and all
    hashes of two sets are those of their parts added up, so two sets of this Jaccard
    similarity have a part of it or more.  A set is also dealt on the higher levels of sets that may be alike.
    """
    level, out = 0, []
    while len(values) > PART << level:
        level += 1
    while True:
        number = (values // np.uint64(64 * WIDE)) % np.uint64(1 << level)
        held = values[np.argsort(number, kind="stable")]
        ends = np.cumsum(np.bincount(number.astype(np.int64), minlength=1 << level))
        parts = np.split(held, ends[:-1])
        out += [(level, i, part) for i, part in enumerate(parts) if len(part) or not level]
        if len(values) / similarity <= (PART << level) + 1e-9:
            return out
        level += 1


def _pieces(values: np.ndarray, node: int, similarity: float, common: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Name, number of hashes with parity words, and keys of each part of a set; a whole set has the name of its node."""
    for level, number, part in set_parts(values, similarity):
        keys, name = prefix_keys(part, similarity, common, ranks), node
        if level:
            keys = keys ^ np.array(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64).view(np.int64)
            name = xxhash.xxh64_intdigest(b"%d %d %d" % (node, level, number), SEED)
            name -= (name >> 63) << 64
        yield name, [len(part), *parity_words(part)], keys


def _common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample and their ranks; they only decide the order of prefixes."""
    texts = docs.select(F.col(text).alias("__text"))
    share = ORDER_TEXTS / max(1, texts.count())
    hashed = F.pmod(F.xxhash64("__text", F.lit(SEED)), F.lit(1 << 30))
    sample = texts.where(hashed < int(min(share, 1.0) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(value.as_py(), shingle).view(np.int64))], ["h"])

    counted = sample.mapInArrow(tidied(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    # Bounded: at most ORDER_SHINGLES pairs of numbers.
    rows = counted.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).collect()
    found = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in rows], np.int64)[order]


def fingerprints(docs: DataFrame, text: str, shingle: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``fp`` (signed 64 bits) of whole texts."""
    ship(docs.sparkSession)
    wanted = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(shingle_hashes(v.as_py(), shingle)) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return wanted.mapInArrow(tidied(run), fields)


def _set_prints(docs: DataFrame, id_col: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """A row for each part of a set: id, ``mark`` of the text, ``fp`` and ``node`` (hash) of the set and its ``n`` shingles;
    ``piece`` and its ``place`` among the parts, ``words`` and ``keys`` (see ``_pieces``)."""
    ship(docs.sparkSession)
    common, ranks = _common_shingles(docs, text, shingle)
    shared = docs.sparkSession.sparkContext.broadcast((common, ranks))
    wanted = docs.select(docs[id_col], F.xxhash64(docs[text]).alias("mark"), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in slices(whole.column(2)):
                batch = whole.slice(start, stop - start)
                rows, sets = [], []
                for at, v in enumerate(batch.column(2)):
                    values = shingle_set(v.as_py(), shingle)
                    node = int.from_bytes(xxhash.xxh64_digest(values.tobytes(), SEED), "big", signed=True)
                    sets.append((fingerprint_of(values.astype(">u8").view(np.uint8).reshape(-1, 8)), node, len(values)))
                    rows += [(at, place, *piece) for place, piece in enumerate(_pieces(values, node, similarity, *shared.value))]
                at, place, piece, words, keys = zip(*rows)
                of_rows = pa.array(at, pa.int64())
                columns = [
                    *(c.take(of_rows) for c in batch.columns[:2]), *(pa.array(x, pa.int64()).take(of_rows) for x in zip(*sets)),
                    pa.array(piece, pa.int64()), pa.array(place, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:2], "fp", "node", "n", "piece", "place", "words", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = "mark bigint, fp bigint, node bigint, n bigint, piece bigint, place int, words array<bigint>, keys array<bigint>"
    return wanted.mapInArrow(tidied(run), f"`{id_col}` {kind}, {fields}")


def byte_postings(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(key, fp)``: every fingerprint under each chosen set of its positional bytes.

    For up to two bits the bytes are taken as four neighbouring pairs of which two are
    intact: six sets of four bytes.  For three bits, five of eight bytes are intact and all
    sets of five would be needed; four pairs leave one intact, so that is the limit here.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the byte index covers up to two differing bits")
    pieces = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    rows = [
        F.lit(number).cast("bigint") * (1 << 32) + pieces[a] * (1 << 16) + pieces[b]
        for number, (a, b) in enumerate(combinations(range(4), 2))
    ]
    return prints.select(F.col("fp").alias("node"), F.array("fp").alias("words"), F.explode(F.array(*rows)).alias("key"))


def _linked(prints: np.ndarray, max_bits: int, min_bytes: int, share: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that reach the byte tally and are verified; blocks bound the memory.

    ``prints`` has one row per fingerprint and a column per 64-bit word.  With a ``share`` the
    first column is the size of a set: neither bits nor sizes may differ by more than this
    share of both sizes.
    """
    ls, rs, limit = [], [], max_bits
    if share is not None:
        sizes, prints = prints[:, 0], prints[:, 1:]
    for at in range(0, len(prints), 256):
        bits = np.zeros((len(prints[at : at + 256]), len(prints)), np.int16)
        equal = np.zeros(bits.shape, np.int16)
        for word in prints.T:
            apart = word[at : at + 256, None] ^ word[None, :]
            bits += np.bitwise_count(apart.view(np.uint64))
            if min_bytes:
                equal += (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=2, dtype=np.int16)
        if share is not None:
            limit = share * (sizes[at : at + 256, None] + sizes[None, :]) + 1e-9
            bits = np.maximum(bits, np.abs(sizes[at : at + 256, None] - sizes[None, :]))
        i, j = np.nonzero((equal >= min_bytes) & (bits <= limit))
        ls.append(i + at)
        rs.append(j)
    return np.concatenate(ls), np.concatenate(rs)


def _forest(nodes: np.ndarray, prints: np.ndarray, max_bits: int, min_bytes: int, share: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest of its group) over one posting; ``nodes`` name the rows of ``prints``."""
    nodes, first = np.unique(nodes, return_index=True)
    a, b = _linked(np.ascontiguousarray(prints[first]), max_bits, min_bytes, share)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def _posting_edges(postings: DataFrame, max_bits: int, min_bytes: int, share: float | None = None) -> DataFrame:
    """Edges inside postings of usual size; members of larger ones as rows with a ``key``.

    ``postings`` has ``key``, ``node`` and ``words``, the fingerprint of the node (after its size with a ``share``, see ``_linked``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src", "dst", "key"]

        def solve(key: int, held: list, large: bool):
            nodes, prints = (np.concatenate(x) for x in zip(*held))
            if large:
                return nodes, nodes, np.full(len(nodes), key), np.ones(len(nodes), bool)
            src, dst = _forest(nodes, prints, max_bits, min_bytes, share)
            return src, dst, np.zeros(len(src), np.int64), np.zeros(len(src), bool)

        def batch_of(parts):
            src, dst, key, open_ = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(key, mask=~open_)], names)

        key, held, size, large = None, [], 0, False
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = batch.column(2).flatten().to_numpy().reshape(len(nodes), -1)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, out = np.r_[0, cuts], []
            ends = np.r_[cuts, len(keys)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                if keys[s] != key:
                    if held and (large or size > 1):
                        out.append(solve(key, held, large))
                    key, held, size, large = keys[s], [], 0, False
                held.append((nodes[s:e], prints[s:e]))
                size += e - s
                if size > POSTING_ROWS:
                    out.append(solve(key, held, True))
                    held, size, large = [], 0, True
            if out:
                yield batch_of(out)
        if held and (large or size > 1):
            yield batch_of([solve(key, held, large)])

    ordered = postings.select("key", "node", "words").repartition(F.col("key")).sortWithinPartitions("key", "node")
    return ordered.mapInArrow(tidied(run), "src bigint, dst bigint, key bigint")


def _ball_edges(open_rows: DataFrame) -> DataFrame:
    """Exact links of large byte postings, linear in their rows.

    Two fingerprints differ in at most two bits exactly if some value is within one bit of
    both.  Each fingerprint is listed under itself and under its 64 one-bit neighbours; a
    list holds at most 65 fingerprints and every member is linked to the smallest.
    """
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("src").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    listed = open_rows.select("src").distinct().select("src", F.explode(F.concat(F.array("src"), near)).alias("middle"))
    least = listed.groupBy("middle").agg(F.min("src").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    return listed.join(least, "middle").where("src <> dst").select("src", "dst").distinct()


def _block_edges(open_rows: DataFrame, prints: DataFrame, max_bits: int, share: float | None = None) -> DataFrame:
    """Links inside large class postings: blocks of rows against blocks, each pair of blocks one task's row.

    ``prints`` has the ``words`` of each ``node``.
    """
    ordered = open_rows.select("key", F.col("src").alias("node")).distinct()
    sizes = ordered.groupBy("key").agg(F.count("*").alias("n"))
    with_block = ordered.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / POSTING_ROWS).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ).join(prints, "node")
    blocks = with_block.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("node", "words")).alias("fps"))
    left = blocks.select("key", "block", F.col("fps").alias("l"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other"))
    pairs = left.join(blocks.select("key", F.col("block").alias("other"), F.col("fps").alias("r")), ["key", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in zip(batch.column(0), batch.column(1)):
                nodes = np.concatenate([s.values.field("node").to_numpy() for s in sides])
                words = np.concatenate([s.values.field("words").flatten().to_numpy() for s in sides])
                src, dst = _forest(nodes, words.reshape(len(nodes), -1), max_bits, 0, share)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return pairs.select("l", "r").repartition(F.xxhash64("l", "r")).mapInArrow(tidied(run), "src bigint, dst bigint")


def _grouped(prints: DataFrame, edges: DataFrame, id_col: str, node: str = "fp") -> DataFrame:
    """``prints`` with ``component_id``: the smallest id in the component of its fingerprint."""
    nodes = prints.groupBy(node).agg(F.min(id_col).alias("least_id"))
    named = nodes.join(components(edges).withColumnRenamed("node", node), node, "left").withColumn(
        "component", F.coalesce("component", node)
    )
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = cut(named.join(ids, "component").select(node, "component_id"))
    return prints.join(by_print, node)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id, fp, component_id)``: one row per document with its component over links of at most ``max_bits`` bits.

    Fingerprints are the majority bits of XXH64 over word shingles of the text in which A-Z
    are lower-cased.  See the module text for NULLs, empty texts and ties.
    """
    prints = landed(fingerprints(docs, text, shingle, keep=(id_col,)), "prints")
    distinct = prints.select("fp").distinct()
    found = landed(_posting_edges(byte_postings(distinct, max_bits), max_bits, 8 - max_bits), "byte_edges")
    edges = found.where("key is null").select("src", "dst")
    open_rows = found.where("key is not null")
    if not open_rows.isEmpty():
        edges = edges.unionByName(_ball_edges(open_rows))
    return _grouped(prints, edges, id_col)


def _shared(postings: DataFrame) -> DataFrame:
    """``(key, node, first)`` of the keys that two or more nodes have; first is the smallest node of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first node of the last key is carried over, as the next batch may go on with the key.
        key, first, sent = np.empty(0, np.int64), np.empty(0, np.int64), True
        for batch in batches:
            keys = np.r_[key, batch.column(0).to_numpy()]
            nodes = np.r_[first, batch.column(1).to_numpy()]
            if not len(keys):
                continue
            begins = np.r_[True, keys[1:] != keys[:-1]]
            starts = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
            several = np.r_[begins[:-1] & ~begins[1:], False]
            if len(key) and sent:
                several[0] = False
            out = ~begins | several
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (keys, nodes, nodes[starts])], ["key", "node", "first"])
            at = starts[-1]
            sent = at < len(keys) - 1 or (at == 0 and len(key) > 0 and sent)
            key, first = keys[at : at + 1], nodes[at : at + 1]

    ordered = postings.select("key", "node").repartition(F.col("key")).sortWithinPartitions("key", "node")
    return ordered.mapInArrow(tidied(run), "key bigint, node bigint, first bigint")


def _alike(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest of its group) by the exact Jaccard similarity of all pairs of sets."""
    nodes, first = np.unique(nodes, return_index=True)
    sets = [sets[i] for i in first]
    sizes = np.array([len(v) for v in sets])
    owner, label = np.repeat(np.arange(len(nodes)), sizes), np.arange(len(nodes))
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    for i in range(len(nodes)):
        if (label == label[0]).all():
            break
        mine = np.zeros(len(distinct), bool)
        mine[codes[ends[i] - sizes[i] : ends[i]]] = True
        both = np.bincount(owner[mine[codes]], minlength=len(nodes))
        near = both >= similarity * (sizes + sizes[i] - both) - 1e-9
        near[i] = True
        joined = np.unique(label[near])
        label[np.isin(label, joined)] = joined[0]
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def _verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """Edges of exact similarity between the nodes of each component of ``candidates``.

    Sets are made anew from one text of each node.  A component's sets are dealt into blocks,
    and each pair of blocks is compared by one task, so memory is bounded.
    """
    groups = components(candidates).join(nodes.select("node", "n", "mark"), "node")
    total = groups.groupBy("component").agg(F.sum("n").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = groups.join(total, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = docs.select(F.xxhash64(docs[text]).alias("mark"), docs[text].alias("__text"))
    one = one.join(dealt.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])
    held = one.join(dealt.select("mark", "node", "component", "block", "blocks"), "mark")
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    rows = pairs.select(*keys, "node", "__text")
    ordered = rows.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            src, dst = _alike(np.array([n for n, _ in held]), [v for _, v in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        key, held = None, []
        for batch in batches:
            for *own, node, value in zip(*batch.columns):
                own = tuple(x.as_py() for x in own)
                if own != key:
                    if len(held) > 1:
                        yield solve()
                    key, held = own, []
                held.append((node.as_py(), shingle_set(value.as_py(), shingle)))
        if len(held) > 1:
            yield solve()

    return ordered.mapInArrow(tidied(run), "src bigint, dst bigint")


def _alike_prints(docs: DataFrame, id_col: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_set_prints`` and the edges between their nodes whose similarity is ``similarity`` or more.

    Texts with the same set are one node.  Two sets of that similarity have a part of it (see
    ``set_parts``), and these share a shingle of their prefixes.  Of texts of ``SHORT`` shingles
    or more, parts whose parity bits or sizes differ too much for it are dropped.  All pairs in
    a component of candidates are then compared exactly.
    """
    prints = landed(_set_prints(docs, id_col, text, shingle, similarity), "prints")
    one = prints.groupBy("piece").agg(F.min(F.struct("node", "n", "mark", "place", "words", "keys")).alias("one"))
    pieces = landed(one.select("piece", "one.*"), "pieces")
    named = pieces.withColumnsRenamed({"node": "whole", "piece": "node"})
    postings = named.select("node", "n", F.explode("keys").alias("key"))
    # A short text is alike only to texts of less than SHORT / similarity shingles.
    short = _shared(postings.where(F.col("n") <= math.ceil(SHORT / similarity))).select(F.col("node").alias("src"), F.col("first").alias("dst"))
    long = _shared(postings.where(F.col("n") >= SHORT)).join(named.select("node", "words"), "node")
    # Sets of this similarity differ in at most this share of both sizes.
    share = (1 - similarity) / (1 + similarity)
    found = landed(_posting_edges(long, 0, 0, share), "prefix_edges")
    edges = found.where("key is null").select("src", "dst").unionByName(short)
    open_rows = found.where("key is not null")
    if not open_rows.isEmpty():
        edges = edges.unionByName(_block_edges(open_rows, named.select("node", "words"), 0, share))
    edges = edges.where("src <> dst").distinct()
    parts = pieces.where("piece <> node")
    for side in ("src", "dst"):
        whole = parts.select(F.col("piece").alias(side), F.col("node").alias("whole"))
        edges = edges.join(whole, side, "left").withColumn(side, F.coalesce("whole", side)).drop("whole")
    one_row = "place = 0"
    return prints.where(one_row), landed(_verified(docs, pieces.where(one_row), edges, text, shingle, similarity), "alike")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, fp, component_id)``: documents whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    ``component_id`` is the smallest id of the group; where ids repeat, groups may share it.
    """
    prints, exact = _alike_prints(docs, id_col, text, shingle, similarity)
    return _grouped(prints.select(id_col, "fp", "node"), exact, id_col, "node").drop("node")


def fingerprint_text(fp) -> Column:
    """Sixteen lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _first_of_groups(prints: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """``(id, mark)`` of the texts that stay: of each component the smallest with an id and the smallest without one."""
    least = F.min(F.struct(id_col, "mark")).alias("least")
    nodes = prints.groupBy("node", F.col(id_col).isNull().alias("unnamed")).agg(least)
    grouped = nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return grouped.groupBy("component", "unnamed").agg(F.min("least").alias("least")).select("least.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the row of the smallest id.

    Groups are of texts, not of ids: an id that repeats over unlike texts keeps a row in each
    of their groups, and of rows with the same id and text one stays.  Rows without an id are
    compared like all others, but no id ranks them: a group keeps one of them, beside its row
    of the smallest id if it has one.  Extra columns stay as they are.
    """
    kept = cut(_first_of_groups(*_alike_prints(docs.select(id_col, text), id_col, text, shingle, similarity), id_col))
    marked = docs.withColumn("__mark", F.xxhash64(docs[text]))
    kept = kept.withColumnRenamed("mark", "__mark")
    # Two joins, as one on ids that may be NULL would deal the texts out a second time for the repeated rows.
    named = marked.where(F.col(id_col).isNotNull()).join(kept, [id_col, "__mark"], "left_semi").dropDuplicates([id_col, "__mark"])
    # Copies without an id may be many: those of a task are settled there.
    unnamed = marked.where(F.col(id_col).isNull()).dropDuplicates(["__mark"]).join(kept.where(F.col(id_col).isNull()), "__mark", "left_semi")
    return named.select(*docs.columns).unionByName(unnamed.select(*docs.columns))
