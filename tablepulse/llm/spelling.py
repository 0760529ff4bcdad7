"""Spelling variants of words: pairs one edit apart, by a relational trie frontier.

The words are laid into two tries, one of the words and one of the reversed words, whose
nodes are prefixes and whose edges form a distributed table (node, first letter, label,
child).  States (word, position, node, edits) are joined with the edges level by level:

* without an edit, a state follows the edge of its next letter, or takes its one edit
  there: a replaced letter or one that the other word has in addition (pairs are found from
  the shorter word, or from the one with the smaller letter);
* with an edit, it follows the edge whose label its next letters spell.

A state that ends at the end of a word with one edit is a pair.  Of two words one edit
apart, the first or the second half agrees, so edits are taken in the second half of a word
only: the reversed trie finds the others.  States meet few children there, and a set of the
word lengths below a node drops those that cannot end.  A chain of nodes with one child
is one edge, so very long words take as many levels as they branch, not as many as they have
letters.  Edges of a level are grouped from its states without an edit, with minima and maxima
combined in the tasks.  States of a node with many words below are dealt over copies of its
edges (``HOT_WORDS`` words each), so no node is one task.

Rows: a NULL text has no words, a NULL id is read as empty.  Repeated rows count as often as
they stand there.  Of ``documents`` only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 5
MIN_COUNT = 3
DROPS = 97  # one word in so many loses a letter
HOT_WORDS = 20_000
STATE = ["word", "n", "size", "least", "pos", "node", "edits", "salts"]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    drops: int | None = DROPS,
) -> DataFrame:
    """``(word, n)`` of the lower-cased runs of letters, after ``drops`` took a letter from some.

    Runs shorter than ``min_length`` cannot become words, so they never leave the scan.  One that gets too short
    by its lost letter becomes NULL, which ``count(word)`` leaves out: a filter would be pushed below the
    projections and work out the word a second time.
    """
    pattern = f"({LETTERS}{{{min_length},}})"
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern))).alias("run"),
    ).select("id", _lower("run").alias("word"))
    if drops:
        mark = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (mark % F.length("word")).cast("int")
        shorter = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        long = F.when(F.length("word") > min_length, shorter)
        runs = runs.select(F.when(mark % drops == 0, long).otherwise(F.col("word")).alias("word"))
    counts = runs.groupBy("word").agg(F.count("word").alias("n"))
    return counts.where(F.col("n") >= max(min_count, 1))


def _lower(run: str) -> Column:
    """Lower case of A-Z only.  Of a text without other letters ``lower`` changes the same, and much faster."""
    plain = F.octet_length(run) == F.length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def _tail(text: str | Column, start: Column | int, size: Column | None = None) -> Column:
    """Letters of ``text`` from ``start`` (from 0), at most ``size`` of them."""
    text = F.col(text) if isinstance(text, str) else text
    start = start if isinstance(start, Column) else F.lit(start)
    return text.substr(start + 1, F.length(text) if size is None else F.greatest(size, F.lit(0)))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix; letters are compared one by one only where ``a`` does not begin with ``b``."""
    first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False).cast("int")
    whole = F.when(first > 0, first - 1).otherwise(F.length(a))
    other = F.length(a) == 0
    apart = other | (F.length(b) == 0) | (F.left(a, F.lit(1)) != F.left(b, F.lit(1)))
    return F.when(F.startswith(a, b), F.length(b)).when(apart, 0).otherwise(whole)


def _bit(length: Column) -> Column:
    """Lengths of 62 and more share a bit."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(length, F.lit(62)))


def _edges(states: DataFrame, hot_words: int) -> DataFrame:
    """Edges of the nodes that hold states without an edit, in as many copies as the node is dealt over."""
    members = states.where((F.col("edits") == 0) & (F.col("pos") < F.col("size")))
    groups = members.groupBy("node", _tail("word", F.col("pos"), F.lit(1)).alias("first")).agg(
        F.min("word").alias("low"),
        F.max("word").alias("high"),
        F.min_by("n", "word").alias("low_n"),
        F.bit_or(_bit(F.col("size"))).alias("sizes"),
        F.count("*").alias("below"),
        F.max("salts").alias("salts"),
    )
    depth = F.length("node")
    label = F.left(_tail("low", depth), _common(_tail("low", depth), _tail("high", depth)))
    edges = groups.withColumn("label", label).select(
        "node", "first", "label", "low_n", "sizes", "below",
        F.concat("node", "label").alias("child"),
        (F.length("low") == F.length("node") + F.length("label")).alias("ends"),
        (1 + F.floor(F.col("below") / hot_words)).cast("int").alias("child_salts"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    return edges


def _moves(rest: Column, label: Column, same: Column, may_edit: Column) -> Column:
    """Ways on along an edge: an array of (letters moved on, edits made).

    ``same`` letters of the label agree with the rest of the word; after them, one edit may follow.
    """
    size = F.length(label)
    left = size - same - 1
    letter = lambda x: _tail(x, same, F.lit(1))
    after = _tail(label, same + 1)
    replaces = (F.length(rest) >= size) & (letter(label) > letter(rest)) & (after == _tail(rest, same + 1, left))
    adds = (F.length(rest) >= size - 1) & (after == _tail(rest, same, left))
    way = lambda by, edits: F.struct(by.alias("by"), F.lit(edits).alias("made"))
    edited = F.array_compact(F.array(F.when(may_edit & replaces, way(size, 1)), F.when(may_edit & adds, way(size - 1, 1))))
    return F.when(same == size, F.array(way(size, 0))).otherwise(edited)


def _step(states: DataFrame, hot_words: int) -> DataFrame:
    """States one level on, with what is known of the node they reached."""
    edges = _edges(states, hot_words)
    here = states.withColumn("salt", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))
    here = here.withColumn("first", _tail("word", F.col("pos"), F.lit(1))).drop("salts")
    rest, fresh = _tail("word", F.col("pos")), F.col("edits") == 0

    def moved(rows: DataFrame, same: Column) -> DataFrame:
        """Rows moved along their edges; an edit is made in the second half of a word only."""
        rows = rows.withColumn("same", same)
        may_edit = fresh & (F.col("pos") + F.col("same") >= F.col("least"))
        ways = rows.withColumn("way", F.explode(_moves(rest, F.col("label"), F.col("same"), may_edit)))
        return ways.select(
            "word", "n", "size", "least", "child", "ends", "low_n", "sizes", "below", "child_salts",
            (F.col("pos") + F.col("way.by")).alias("pos"), (F.col("edits") + F.col("way.made")).alias("edits"),
        )

    along = moved(here.join(edges, ["node", "first", "salt"]), _common(rest, F.col("label")))
    turning = here.where(fresh & (F.col("pos") >= F.col("least")))
    aside = turning.join(edges.withColumnRenamed("first", "other"), ["node", "salt"]).where(F.col("other") != F.col("first"))
    # A word that is to end here needs as many letters below the node as it has left.
    fits = F.col("sizes").bitwiseAND(_bit(F.length("child") + F.col("size") - F.col("pos"))) != 0
    return along.unionByName(moved(aside, F.lit(0))).where(fresh | fits)


def near_words(counts: DataFrame, min_length: int = MIN_LENGTH, hot_words: int = HOT_WORDS) -> DataFrame:
    """``(word, n, other, other_n)``: all pairs of words one edit apart, in both directions."""
    begin = min(min_length // 2, 2)  # no edit is taken before; at most 2 x 90**2 nodes to start from
    half = lambda x: (x / 2).cast("int")
    forward = counts.select(
        F.concat(F.lit(">"), "word").alias("word"), "n", F.length("word").alias("size"), half(F.length("word") + 1).alias("least")
    )
    backward = counts.select(
        F.concat(F.lit("<"), F.reverse("word")).alias("word"), "n", F.length("word").alias("size"), half(F.length("word")).alias("least")
    )
    # The mark of the trie is the first letter of every word and node.
    both = forward.unionByName(backward).withColumns({"size": F.col("size") + 1, "least": F.col("least") + 1})
    begun = both.select(
        "word", "n", "size", "least", F.lit(begin + 1).alias("pos"), F.left("word", F.lit(begin + 1)).alias("node"), F.lit(0).alias("edits")
    )
    salts = begun.groupBy("node").agg((1 + F.floor(F.count("*") / hot_words)).cast("int").alias("salts"))
    states, pairs, level = landed(begun.join(salts, "node").select(*STATE), "states"), [], 0
    while not states.isEmpty():
        level += 1
        made = landed(_step(states, hot_words), f"level_{level}")
        done = (F.col("edits") == 1) & (F.col("pos") == F.col("size"))
        pairs.append(made.where(done & F.col("ends")).select("word", "n", F.col("child").alias("other"), F.col("low_n").alias("other_n")))
        # A node with one word below has no edges; a word that ends at a node may still be the shorter one of a pair.
        on = made.where((F.col("below") > 1) & ((F.col("edits") == 0) | (F.col("pos") < F.col("size"))))
        states = on.select(
            "word", "n", "size", "least", "pos", F.col("child").alias("node"), "edits", F.col("child_salts").alias("salts")
        )
    if not pairs:
        empty = counts.where(F.lit(False)).select("word", "n")
        return empty.withColumns({"other": F.col("word"), "other_n": F.col("n")})
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)

    def plain(name: str) -> Column:
        bare = F.col(name).substr(F.lit(2), F.length(name))
        return F.when(F.col(name).startswith("<"), F.reverse(bare)).otherwise(bare)

    found = found.select(plain("word").alias("word"), "n", plain("other").alias("other"), "other_n").distinct()
    found = landed(found, "pairs")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def group_variants(counts: DataFrame, ratio: int = 2, min_length: int = MIN_LENGTH, hot_words: int = HOT_WORDS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every row of ``counts (word, n)``.

    The form is the most frequent near word, if it is ``ratio`` times as frequent as the word.
    Counts at least double from form to form (``ratio`` must be 2 or more), so following forms
    ends, and paths are halved in each round.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counts = landed(counts.select("word", "n"), "words")
    best = near_words(counts, min_length, hot_words).groupBy("word").agg(
        F.max("n").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best")
    )
    most = -F.col("best.rank")
    good = most >= ratio * F.col("own")
    best = landed(
        best.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, most).alias("form_n")), "forms"
    )
    paths = best.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = landed(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        paths = joined.select("word", "root")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            break
    return counts.join(best, "word", "left").join(paths, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
