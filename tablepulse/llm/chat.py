"""Chat formatting that is checked by its own grammar.

A turn is ``<s>`` and its role's frame around the text; a conversation is its turns in order.
Inside a text every control string must have a backslash in front, which the parser takes
away again.  Texts are first rendered as they are, the result is parsed by the grammar and
the recovered turns are compared with the source; turns that conflict are escaped until both
are identical.  Escaping puts one more backslash in front of each control string (and of the
backslashes before it), so it can always be undone.

Long conversations are written in chunks that begin at a turn, so neither a task nor a row
ever holds a whole long conversation; its chunks follow each other by ``first_turn`` and
``part``.  Loss spans are code point ranges of a chunk's text, one per assistant text.

Rows: NULL texts and roles are empty.  Turns with one number follow each other by role and
text, repeated rows stay.  Rows without a conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import ship

CHUNK_TURNS = 256
CHUNK_CHARS = 1 << 20
BEGIN = "<s>"
# Frames of roles; any other role is named in hex in a frame of its own.
FRAMES = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER = ("[ROLE={}] ", " [/ROLE]")
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|<<SYS>>|<</SYS>>|\[ROLE=[0-9a-f]*\]|\[/ROLE\]"
_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({CONTROL})")
_OPEN = re.compile(r"<s>(?:(<<SYS>>)|(\[INST\])|(\[OUT\])|\[ROLE=((?:[0-9a-f][0-9a-f])*)\]) ")
_ROLES = ("system", "user", "assistant")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def frame(role: str) -> tuple[str, str]:
    if role in FRAMES:
        return FRAMES[role]
    return OTHER[0].format(role.encode("utf-8", "surrogatepass").hex()), OTHER[1]


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def parse(rendered: str) -> list[tuple[str, int, int]]:
    """Role and text range of each turn; the only reading that the grammar allows.

    After an opening, the first control string without a backslash must close that role's frame.
    """
    turns, at = [], 0
    while at < len(rendered):
        head = _OPEN.match(rendered, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        known = head.lastindex and head.lastindex <= 3
        role = _ROLES[head.lastindex - 1] if known else bytes.fromhex(head[4]).decode("utf-8", "surrogatepass")
        close = frame(role)[1]
        for mark in _ESCAPE.finditer(rendered, head.end()):
            if not mark[1]:
                break
        else:
            raise GrammarError(f"the turn at {at} does not end")
        start, stop = head.end(), mark.start() - 1
        if mark[2] != close[1:] or stop < start or rendered[stop] != " ":
            raise GrammarError(f"stray control string at {mark.start()}")
        turns.append((role, start, stop))
        at = mark.end()
    return turns


def recovered(rendered: str) -> list[Turn]:
    return [(role, unescape(rendered[a:b])) for role, a, b in parse(rendered)]


def _agrees(turns: list[Turn], rendered: str) -> bool:
    try:
        return recovered(rendered) == turns
    except GrammarError:
        return False


def _one(role: str, text: str) -> str:
    opening, closing = frame(role)
    return f"{BEGIN}{opening}{text}{closing}"


def render(turns: list[Turn]) -> str:
    """Text of the turns from which the parser recovers exactly them."""
    texts = [text for _, text in turns]
    whole = "".join(_one(role, text) for (role, _), text in zip(turns, texts))
    if _agrees(turns, whole):
        return whole
    for i, (role, text) in enumerate(turns):
        if not _agrees([(role, text)], _one(role, text)):
            texts[i] = escape(text)
    whole = "".join(_one(role, text) for (role, _), text in zip(turns, texts))
    if not _agrees(turns, whole):
        raise AssertionError("escaped turns must parse")
    return whole


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conversation, first_turn, part, text, loss, n_turns)``: one row per chunk.

    ``loss`` lists the ranges of assistant texts in the chunk's text.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        turns[conversation].cast("bigint").alias("conversation"),
        turns[turn].cast("bigint").alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"),
        F.coalesce(turns[text], F.lit("")).alias("text"),
    )
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "conversation", "turn").sortWithinPartitions("conversation", "turn", "role", "text")
    schema = "conversation bigint, first_turn bigint, part bigint, text string, loss array<struct<start:bigint,stop:bigint>>, n_turns bigint"
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.int64()]
    names = ["conversation", "first_turn", "part", "text", "loss", "n_turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Turn] = []
        key, first, part, size = None, None, 0, 0
        made: list[tuple] = []

        def close() -> None:
            nonlocal part, size
            whole = render(held)
            loss = [{"start": a, "stop": b} for role, a, b in parse(whole) if role == "assistant"]
            made.append((key, first, part, whole, loss, len(held)))
            held.clear()
            part, size = part + 1, 0

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)
            made.clear()
            return out

        for batch in batches:
            for conv, number, role_, text_ in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conv != key or len(held) >= CHUNK_TURNS or size + len(text_) > CHUNK_CHARS):
                    close()
                if not held:
                    part = part if conv == key else 0
                    key, first = conv, number
                held.append((role_, text_))
                size += len(text_)
            if made:
                yield batch_of()
        if held:
            close()
        if made:
            yield batch_of()

    return ordered.mapInArrow(run, schema)


def summaries(chunks: DataFrame) -> DataFrame:
    """``(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` parsed from chunks.

    The chunks of a conversation pass one after the other; only running digests are kept.
    """
    ship(chunks.sparkSession)
    ordered = chunks.select("conversation", "first_turn", "part", "text", "loss").repartition("conversation")
    ordered = ordered.sortWithinPartitions("conversation", "first_turn", "part")
    schema = "conversation bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        key, state, made = None, None, []

        def close() -> None:
            n, all_, chars, loss, size = state
            made.append((key, n, all_.hexdigest(), chars, loss.hexdigest(), size))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)
            made.clear()
            return out

        for batch in batches:
            for conv, _, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in recovered(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    under = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if made:
                yield batch_of()
        if state is not None:
            close()
            yield batch_of()

    return ordered.mapInArrow(run, schema)
