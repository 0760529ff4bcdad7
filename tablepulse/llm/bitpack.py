"""Token ids in files of fixed-width bit fields.

A shard file holds documents in ascending id order, every token id in the fewest bits that
the vocabulary needs::

    magic "TPB1" | bits, ids per block, documents, ids (four unsigned 64-bit numbers)
    document ids (int64 each, the smallest int64 for NULL) | first id of each document, and the end
    byte offset of each block, and the end | blocks

A block holds a fixed number of ids and starts at a byte, so block and offset of any id are
known and ``numpy`` unpacks a block at once; one document is read without the others.
Shards are written by tasks that hold a range of the ids, under a passing name that is then
renamed, so a repeated task leaves the same files.  A manifest (Parquet, one row per shard)
gives the ids in all shards before.

Added tokens of the tokenizer that stand in a text become their ids, as in the library.

Rows: a NULL or empty text holds only the end id.  NULL document ids come first, rows that
repeat an id follow each other by their text.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm.pieces import PieceCache, slices
from tablepulse.llm.storage import ship

MAGIC = b"TPB1"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 24
NULL_ID = -(1 << 63)
JOINED = 256  # words per string given to the tokenizer
_HEAD = struct.Struct("<4sQQQQ")
_SPACE = regex.compile("[\t-\r]")
_CACHES: dict[str, PieceCache] = {}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2 ** bits`` as consecutive fields of ``bits`` bits, highest bit first."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(planes[:, 32 - bits :].ravel()).tobytes()


def unpack(block: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(block, ">u2", n).astype(np.uint32)
    planes = np.zeros((n, 32), np.uint8)
    planes[:, 32 - bits :] = np.unpackbits(np.frombuffer(block, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(planes, axis=1).view(">u4").ravel().astype(np.uint32)


class ShardWriter:
    """Collects documents and packs full blocks as they come."""

    def __init__(self, bits: int):
        self.bits, self.docs, self.first = bits, [], [0]
        self.blocks: list[bytes] = []
        self.open = np.empty(0, np.int32)

    def add(self, docs: list[int], flat: np.ndarray, ends: np.ndarray) -> None:
        base = self.first[-1]
        self.docs += docs
        self.first += (ends + base).tolist()
        ids = np.r_[self.open, flat]
        full = len(ids) // BLOCK_IDS * BLOCK_IDS
        self.blocks += [pack(ids[a : a + BLOCK_IDS], self.bits) for a in range(0, full, BLOCK_IDS)]
        self.open = ids[full:]

    def content(self) -> bytes:
        blocks = self.blocks + ([pack(self.open, self.bits)] if len(self.open) else [])
        offsets = np.r_[0, np.cumsum([len(b) for b in blocks], dtype=np.int64)]
        head = _HEAD.pack(MAGIC, self.bits, BLOCK_IDS, len(self.docs), self.first[-1])
        tables = [np.array(x, "<i8").tobytes() for x in (self.docs, self.first, offsets)]
        return b"".join([head, *tables, *blocks])


class ShardReader:
    """Random access to one shard's bytes."""

    def __init__(self, content: bytes):
        magic, self.bits, self.block_ids, n_docs, self.n_ids = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.content, at = content, _HEAD.size
        self.docs = np.frombuffer(content, "<i8", n_docs, at)
        self.first = np.frombuffer(content, "<i8", n_docs + 1, at := at + 8 * n_docs)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(content, "<i8", n_blocks + 1, at := at + 8 * (n_docs + 1))
        self.payload = at + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start .. stop - 1`` of the shard; only their blocks are unpacked."""
        if start >= stop:
            return np.empty(0, np.uint32)
        low, high = start // self.block_ids, -(-stop // self.block_ids)
        begin, end = self.payload + self.offsets[low], self.payload + self.offsets[high]
        n = min(high * self.block_ids, self.n_ids) - low * self.block_ids
        # A block of 4,096 fields fills whole bytes at any width, so blocks unpack together.
        found = unpack(self.content[begin:end], self.bits, n)
        return found[start - low * self.block_ids : stop - low * self.block_ids]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.first[number]), int(self.first[number + 1]))


@cache
def _tokenizer(path: str):
    """The tokenizer of a file, loaded once a process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Texts are split at added tokens before; what looks like one after lower-casing is ordinary text.
    tokenizer.encode_special_tokens = True
    return tokenizer


def _encoder(path: str):
    """Ids of distinct words by the tokenizers library; words are joined to few strings."""
    tokenizer = _tokenizer(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        coded = tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        lengths, flat = [], []
        for group, one in zip(groups, coded):
            starts = np.r_[0, np.cumsum([len(p) + 1 for p in group])]
            begin = np.array([a for a, _ in one.offsets], np.int64)
            lengths.append(np.diff(np.searchsorted(begin, starts)))
            flat.append(np.array(one.ids, np.int64))
        return np.concatenate(lengths), np.concatenate(flat)

    return encode


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokenizer's added tokens, which are found in texts before anything else."""
    found = _tokenizer(path).get_added_tokens_decoder()
    for token in found.values():
        if token.normalized or token.lstrip or token.rstrip or token.single_word:
            raise ValueError(f"added token {token.content!r} is not matched as it stands")
    return {token.content: number for number, token in found.items()}


def words_of(text: str | None, tokens: regex.Pattern) -> list[str]:
    """Words of a whole text, those in ASCII lower-cased; added tokens as words with a blank before them."""
    words = []
    for number, part in enumerate(tokens.split(text or "")):
        words += [" " + part] if number % 2 else [w.lower() if w.isascii() else w for w in _SPACE.sub(" ", part).split(" ")]
    return [w for w in words if w]


def encode_texts(texts: pa.Array, cache: PieceCache, tokens: regex.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow column, and where each text ends among them."""
    texts = pc.fill_null(texts, "")
    if tokens is not None and pc.any(pc.match_substring_regex(texts, tokens.pattern)).as_py():
        return cache.ids([words_of(t, tokens) for t in texts.to_pylist()])
    # Words are told apart by Arrow; Python sees each distinct one.  Blanks at the ends make empty words.
    listed = pc.ascii_split_whitespace(texts)
    coded = listed.flatten().dictionary_encode()
    found, codes = coded.dictionary, coded.indices.to_numpy()
    real = codes != pc.index(found, "").as_py()
    ends = np.r_[0, np.cumsum(real)][listed.offsets.to_numpy()[1:] - listed.offsets[0].as_py()]
    lower = pc.if_else(pc.string_is_ascii(found), pc.ascii_lower(found), found)
    return cache.coded(lower.to_pylist(), codes[real], ends)


def token_pattern(path: str) -> regex.Pattern | None:
    """Pattern with one group for all added tokens, longest first."""
    listed = sorted(added_tokens(path), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, listed)) + ")") if listed else None


def word_cache(path: str) -> PieceCache:
    """Ids of words (see ``words_of``).

    Words in ASCII come lower-cased; any other word goes to the tokenizer as it is, since its
    normalization comes before lower-casing and may change where the word is split.
    """
    if path not in _CACHES:
        encode, tokens = _encoder(path), added_tokens(path)

        def words(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            added = np.array([w[:1] == " " for w in new], bool)
            if not added.any():
                return encode(new)
            # An added token has the one id that it stands for.
            plain, own = [w for w in new if w[:1] != " "], [tokens[w[1:]] for w in new if w[:1] == " "]
            sizes, flat = encode(plain) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
            lengths = np.ones(len(new), np.int64)
            lengths[~added] = sizes
            before = np.r_[0, np.cumsum(sizes)]
            return lengths, np.insert(flat, before[np.cumsum(~added)[added]], own)

        _CACHES[path] = PieceCache(words)
    return _CACHES[path]


def write_ids(
    docs: DataFrame, tokenizer: str, folder: str, bits: int, id_col: str = "doc_id", text: str = "text", end_id: int = 1,
    shard_ids: int = SHARD_IDS, partitions: int | None = None,
) -> DataFrame:
    """Encode whole texts into shard files below ``folder``; the manifest, one row per shard.

    ``tokenizer`` is a file of the tokenizers library whose words encode independently of each
    other (white space is dropped), readable on every executor.  ``folder`` must be reachable
    by all executors.  Documents are dealt out by ranges of id (and text, for repeated ids).
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("mark"))
    ordered = rows.repartitionByRange(n, "id", "mark").sortWithinPartitions("id", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        part, count, writer, cache = TaskContext.get().partitionId(), 0, ShardWriter(bits), word_cache(tokenizer)
        tokens = token_pattern(tokenizer)

        def close() -> pa.RecordBatch:
            nonlocal count, writer
            name = f"part-{part:06d}-{count:05d}.bin"
            passing = posixpath.join(root, f"_{uuid.uuid4().hex}")
            with files.open_output_stream(passing) as out:
                out.write(writer.content())
            files.move(passing, posixpath.join(root, name))
            row = [[name], [part], [count], [len(writer.docs)], [writer.first[-1]]]
            count, writer = count + 1, ShardWriter(bits)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file", "part", "number", "n_docs", "n_ids"])

        for whole in batches:
            for start, stop in slices(whole.column(1)):
                batch = whole.slice(start, stop - start)
                flat, ends = encode_texts(batch.column(1), cache, tokens)
                # The end id goes behind the ids of each document.
                flat = np.insert(flat, ends, end_id)
                ids = [NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
                writer.add(ids, flat, ends + np.arange(1, len(ends) + 1))
                if writer.first[-1] >= shard_ids:
                    yield close()
        if writer.docs:
            yield close()

    found = ordered.mapInArrow(run, "file string, part bigint, number bigint, n_docs bigint, n_ids bigint")
    path = f"{folder.rstrip('/')}/_manifest"
    found.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_le)`` from the shard files, documents in their order.

    ``start`` counts the ids of all documents before; ``ids_le`` holds the ids as unsigned
    32-bit little-endian numbers.
    """
    ship(spark)
    # One row per shard: small enough for one task at any corpus size.
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    base = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("file", "base")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(folder)
    shards = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length").join(base, "file")

    # Tasks get paths and read the files themselves, so contents are not shuffled.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                files, name = pa.fs.FileSystem.from_uri(_plain_uri(path))
                with files.open_input_stream(name) as stream:
                    shard = ShardReader(stream.read())
                step = 1 << 20
                at = 0
                while at < len(shard.docs):
                    to = max(at + 1, int(np.searchsorted(shard.first, shard.first[at] + step)) - 1)
                    first = shard.first[at : to + 1]
                    data = shard.ids(int(first[0]), int(first[-1])).astype("<u4").tobytes()
                    offsets = (first - first[0]) * 4
                    docs = shard.docs[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, pa.int64(), mask=docs == NULL_ID),
                            pa.array(first[:-1] + base),
                            pa.array(np.diff(first)),
                            pa.Array.from_buffers(
                                pa.binary(), to - at, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data)]
                            ),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_le"],
                    )
                    at = to

    tasks = shards.select("path", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return tasks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_le binary")


def _plain_uri(path: str) -> str:
    """Spark writes local paths as ``file:/...``; Arrow wants ``file:///...``."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
