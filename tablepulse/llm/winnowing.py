"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item, or the whole item where it is shorter.
For windows of m words, every run of k = ceil(m / 2) words is hashed and of each m - k + 1
consecutive hashes the smallest (the leftmost, if equal) is kept as a fingerprint.  Equal
windows keep the same hash at the same place, so a window of an item that stands in a
document shares a fingerprint with it: no shared window is missed, and only about 2 of
m - k + 2 places of a document are looked up.

1. Fingerprints of the documents are joined with the distinct ones of the items.  The items
   have each fingerprint once, so a common phrase multiplies no rows.
2. Each hit is extended to the windows around it, which are joined word for word with the
   windows of the items.  Only documents with a hit are read again for this.
3. Word counts come from the union of a document's matching windows, items by distinct id.

Both sides are shuffled or broadcast as Spark decides from their measured sizes; nothing is
broadcast by a hint.

Rows: a NULL text has no words.  Every input row is returned once, with the columns
``id``, ``n_words``, ``n_hit`` and ``items`` (sorted) only, so further columns cannot clash.
Rows are told apart by two 64-bit
hashes of id and text; repeated rows get equal results, and rows that share an id are judged
by their own text.  An item without an id marks words but is not listed; items that repeat an
id count once.  Items without words have no window, and an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _numbers(last: Column) -> Column:
    """1 .. last; empty below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def fingerprints(ws: Column, length: int) -> Column:
    """Kept places of windows of ``length`` words: an array of (length, place from 1, hash)."""
    k = -(-length // 2)
    span = length - k + 1

    def kept(hashes: Column) -> Column:
        def smallest(i: Column) -> Column:
            return _once(F.slice(hashes, i, span), lambda part: (i - 1 + F.array_position(part, F.array_min(part))).cast("int"))

        places = F.array_distinct(F.transform(_numbers(F.size(hashes) - (span - 1)), smallest))
        return F.transform(
            places, lambda p: F.struct(F.lit(length).alias("length"), p.alias("place"), F.element_at(hashes, p).alias("print"))
        )

    hashed = lambda w: F.transform(_numbers(F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return _once(_once(ws, hashed), kept)


def _window_text(ws: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(ws, start, length), " ")


def item_windows(items: DataFrame, item_col: str, text: str, window: int = WINDOW) -> DataFrame:
    """``(item, length, window)`` of every place of every item; words of a window are joined by a blank."""
    ws = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    sized = ws.withColumn("length", F.least(F.size("ws"), F.lit(window)))
    placed = sized.withColumn("start", F.explode(_numbers(F.size("ws") - F.col("length") + 1)))
    return placed.select("item", "length", _window_text(F.col("ws"), F.col("start"), F.col("length")).alias("window"))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` of every row of ``docs``."""
    windows = landed(item_windows(items, item_col, item_text, window).distinct(), "item_windows")
    # At most one row per length, and lengths are at most ``window``.
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.col(text).alias("text"),
        F.xxhash64(id_col, text).alias("key"),
        F.xxhash64(F.lit(1), text, id_col).alias("mark"),
    )

    def all_prints(ws: Column) -> Column:
        return F.concat(F.array().cast("array<struct<length:int,place:int,print:bigint>>"), *[fingerprints(ws, m) for m in lengths])

    distinct = windows.select("length", "window").distinct()
    known = distinct.select(F.inline(all_prints(F.split("window", " ")))).select("length", "print").distinct()
    known = landed(known.withColumn("known", F.lit(True)), "item_prints")

    # The row of length 0 stands for the document itself.
    own = F.struct(F.lit(0).alias("length"), F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("print"))

    def scan(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), F.concat(F.array(own), all_prints(ws)).alias("prints"))

    scanned = keyed.select("id", "key", "mark", _once(words(F.col("text")), scan).alias("s"))
    looked_up = scanned.select("id", "key", "mark", F.col("s.n_words").alias("n_words"), F.inline("s.prints"))
    hits = looked_up.join(known, ["length", "print"], "left").where(F.col("known") | (F.col("length") == 0))
    found = hits.groupBy("key", "mark").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("length") == 0).alias("copies"),
        F.collect_set(F.when(F.col("length") > 0, F.struct("length", "place"))).alias("places"),
    )
    found = landed(found, "print_hits")

    # Extension: a window of m words that keeps place p starts at most m - ceil(m / 2) words before it.
    marked = found.where(F.size("places") > 0).select("key", "mark", "places")
    again = keyed.select("key", "mark", "text").join(marked, ["key", "mark"]).select(
        "key", "mark", "places", words(F.col("text")).alias("ws")
    )

    def around(hit: Column) -> Column:
        first = F.greatest(F.lit(1), hit["place"] - F.floor(hit["length"] / 2).cast("int"))
        last = F.least(hit["place"], F.size("ws") - hit["length"] + 1)
        some = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda s: F.struct(s.alias("start"), hit["length"].alias("length")))

    starts = again.select("key", "mark", "ws", F.array_distinct(F.flatten(F.transform("places", around))).alias("starts"))

    def with_words(ws: Column) -> Column:
        return F.transform(
            "starts", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), _window_text(ws, s["start"], s["length"]).alias("window"))
        )

    tried = starts.select("key", "mark", F.inline(_once(F.col("ws"), with_words)))
    matches = landed(tried.join(distinct, ["length", "window"], "left_semi"), "window_matches")
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "length"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, w: F.struct(
            F.greatest(acc["end"], w["start"] + w["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), w["start"] + w["length"] - F.greatest(w["start"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    counted = matches.groupBy("key", "mark").agg(covered.alias("n_hit"))
    of_items = matches.select("key", "mark", "length", "window").distinct().join(windows, ["length", "window"])
    listed = of_items.groupBy("key", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = found.join(counted, ["key", "mark"], "left").join(listed, ["key", "mark"], "left")
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
