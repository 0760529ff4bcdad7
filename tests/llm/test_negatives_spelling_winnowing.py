"""Hard negatives, spelling variants and decontamination against plain computations, with edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepulse.llm import negatives, spelling, winnowing
from tablepulse.llm.queries import QUERIES

# --- hard negatives -----------------------------------------------------------

VECTORS = "vec_id bigint, label bigint, embedding array<double>, score string, id string"


def plain_negatives(rows, anchor, positives=5, k=10, low=30, high=90):
    """Rows as (id, label, whole vector), without repeats."""
    out = []
    for a_id, a_label, a in rows:
        if not anchor(a_id):
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, label) for i, label, v in rows if i != a_id and len(v) == len(a)]
        for minus, p_id, _ in sorted(s for s in scored if s[2] == a_label)[:positives]:
            good = sorted(s for s in scored if s[2] != a_label and -low * minus <= -100 * s[0] <= -high * minus)
            out += [(a_id, p_id, rank, n_id, -minus, -s) for rank, (s, n_id, _) in enumerate(good[:k], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    return sorted(map(tuple, negatives.hard_negatives(table, F.col("id") % 5 == 0, scale=1.0, **options).collect()))


@pytest.mark.parametrize("shard_rows,chunk_anchors", [(16_384, 4_096), (70, 11)])
def test_negatives_equal_brute_force(spark, shard_rows, chunk_anchors):
    some = random.Random(3)
    # Few values, so scores tie often; zero vectors have no live dimension.
    rows = [(i, some.randrange(4), [float(some.randrange(-2, 3)) for _ in range(6)]) for i in range(400)]
    rows += [(1000, 1, [0.0] * 6), (1005, 1, [0.0] * 6), (1010, 2, [1.0, 2.0]), (1011, 2, [1.0, 1.0]), (1012, 3, [2.0, 0.0])]
    expected = plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows + rows[:50], shard_rows=shard_rows, chunk_anchors=chunk_anchors) == expected


def test_negatives_leave_out_broken_rows(spark):
    good = [(0, 1, [2.0, 1.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0, 1.0]), (3, 2, [2.0, 0.0])]
    nan, inf = float("nan"), float("inf")
    broken = [(None, 1, [1.0, 1.0]), (10, None, [1.0, 1.0]), (15, 1, None), (20, 1, []), (25, 2, [nan, 1.0]), (30, 2, [inf, 1.0]), (35, 2, [None, 1.0])]
    assert mined(spark, good + broken) == plain_negatives(good, lambda i: i % 5 == 0) != []
    assert mined(spark, broken) == [] == mined(spark, [])


def test_negatives_with_large_components(spark):
    """Scores above 2**53 stay exact; one that no long can hold is an error."""
    rows = [(0, 1, [3e8 + 1, 1.0]), (1, 1, [3e8 + 3, 2.0]), (2, 2, [1e8 + 1, 7.0]), (3, 2, [1e8 + 1, 8.0]), (4, 3, [-1e8, 5.0])]
    assert mined(spark, rows) == plain_negatives([(i, c, [int(x) for x in v]) for i, c, v in rows], lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark, [(0, 1, [1e15]), (1, 1, [1e15])])


class Counted:
    """Labels that note how many rows are looked at."""

    def __init__(self, labels, met):
        self.labels, self.met = labels, met

    def __getitem__(self, rows):
        self.met.append(len(rows))
        return self.labels[rows]


def test_walk_stops_early():
    """The threshold ends the sorted access before all rows are met."""
    some = np.random.default_rng(5)
    vectors = np.floor(256 * some.normal(size=(20_000, 3)))
    lists = negatives.Lists(np.arange(20_000), np.zeros(20_000, np.int64), np.ones(20_000, np.int64), vectors)
    met = []
    lists.labels = Counted(lists.labels, met)
    scores, rows = negatives.walk(lists, vectors[0], -1, 1, [(negatives.LEAST, negatives.MOST)], 5, True)[0]
    order = np.lexsort((np.arange(20_000), -(vectors @ vectors[0])))[:5]
    assert rows.tolist() == order.tolist() and scores.tolist() == (vectors @ vectors[0])[order].astype(int).tolist()
    assert sum(met) < 10_000


# --- spelling variants --------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :])


def plain_variants(counts: dict[str, int]) -> list[tuple]:
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w] or "", counts.get(form[w], 0), root(w)) for w, n in counts.items())


def variants(spark, counts, **options):
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), **options)
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in found.collect())


@pytest.mark.parametrize("hot_words", [20_000, 7])
def test_variants_equal_brute_force(spark, hot_words):
    """Words over few letters, so that most have near words; copies of hot nodes change nothing."""
    some = random.Random(11)
    words = {"".join(some.choice("abé") for _ in range(some.randrange(5, 9))) for _ in range(300)}
    counts = {w: some.choice([3, 4, 6, 12, 24, 50]) for w in words}
    assert variants(spark, counts, hot_words=hot_words) == plain_variants(counts)


def test_variants_of_very_long_words(spark):
    """Levels follow the branches: words of 50,000 letters take as few as short ones."""
    long = "ab" * 25_000
    counts = {long: 40, long[:9] + long[10:]: 10, long + "c": 5, long[:-1] + "z": 3, "aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20}
    assert variants(spark, counts) == plain_variants(counts)


def test_variants_of_no_and_single_words(spark):
    assert variants(spark, {}) == []
    assert variants(spark, {"alone": 9}) == [("alone", 9, 0, "", 0, "alone")]
    with pytest.raises(ValueError):
        variants(spark, {"alone": 9}, ratio=1)


def test_word_counts(spark):
    texts = [(1, "Étude ÉTUDE étude über-ÜBERß naïve NAÏVE naïve x1naïve"), (2, None), (3, ""), (None, "naïve Naïve"), (1, "étude")]
    texts += [(i, f"some words repeat every time repeat{'x' * (i % 3)}") for i in range(400)]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[run] += len(run) >= 5
    assert {r.word: r.n for r in spelling.word_counts(table).collect()} == {w: n for w, n in counts.items() if n >= 3}


# --- decontamination ----------------------------------------------------------

def plain_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        its = split(t)
        m = min(len(its), window)
        windows = {tuple(its[i : i + m]) for i in range(len(its) - m + 1)} if its else set()
        for i in range(len(ws) - m + 1 if its else 0):
            if tuple(ws[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found |= {str(item)} if item is not None else set()
    return len(ws), len(hit), sorted(found)


def checked(spark, docs, items):
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id bigint, text string, key string, n_words int")
    b = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id bigint, text string, window string")
    found = winnowing.decontaminate(d, b)
    rows = Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())
    assert rows == Counter((i, n, hit, tuple(its)) for i, t in docs for n, hit, its in [plain_hits(t, items)])
    return found


def test_decontamination_equals_brute_force(spark):
    """Items of 1 to 40 words over few words, so that windows repeat, overlap and meet by chance."""
    some = random.Random(7)
    text = lambda n, pool: " ".join(some.choice(pool) for _ in range(n))
    items = [(i % 30, text(some.randrange(1, 40), "abcdefgh" if i % 2 else ["Wort", "été", "x1", "und"])) for i in range(40)]
    items += [(None, text(14, "abcd")), (99, None), (98, ""), (97, "...")]
    docs = []
    for i in range(120):
        item = some.choice(items)[1] or ""
        cut = item.split()[: some.randrange(1, 30)]
        docs.append((i % 100, " ".join([text(some.randrange(0, 30), "abcdefghij"), *cut, text(some.randrange(0, 20), "stuvw")]).upper()))
    docs += [(None, None), (None, None), (5, ""), (6, items[0][1]), (6, items[0][1]), (7, "q " * 30_000 + items[1][1] + " r" * 30_000)]
    checked(spark, docs, items)


def test_shared_span_of_window_length_is_never_missed(spark):
    some = random.Random(2)
    words = [f"w{n}" for n in range(3_000)]
    items = [(i, " ".join(some.sample(words, 60))) for i in range(30)]
    docs = []
    for i in range(300):
        its = some.choice(items)[1].split()
        at, n = some.randrange(50), some.choice([9, 10])
        docs.append((i, " ".join([*some.sample(words, 5), *its[at : at + n], *some.sample(words, 5)])))
    hits = {r.id: r.n_hit for r in checked(spark, docs, items).collect()}
    assert sum(n >= 10 for n in hits.values()) > 100


def test_decontamination_of_empty_tables(spark):
    assert checked(spark, [], [(1, "a b c")]).count() == 0
    checked(spark, [(1, "a b c"), (None, None)], [])
    checked(spark, [(1, "a b c")], [(1, None), (2, "")])


def test_decontamination_runs_no_python(spark, folder):
    plan = QUERIES["op13_winnowing"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_plain_one_edit():
    """The plain rule used above, on pairs made by hand."""
    assert one_edit("abcde", "abcdef") and one_edit("abcde", "abxde") and one_edit("bcdef", "abcdef")
    assert not one_edit("abcde", "abdce") and not one_edit("abcde", "abcde") and not one_edit("abcde", "abcdefg")
