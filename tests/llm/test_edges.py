"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablepulse.llm import bitpack, bpe, chat, divergence, kdsearch, licences, mixing, simhash, substrings, toxicity
from tablepulse.llm.components import components
from tablepulse.llm.storage import new_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "word " * 60_000 + "x" * 50_000
PASSAGE = " ".join(f"p{i}" for i in range(60))
# Extra columns have the names that the operators use for results.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, fp bigint, n_words bigint, ids string, component_id string, mix_tokens string, kept string"
)
EXTRA = (0.5, 7, 9, "i", "c", "m", "k")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, f"Alpha beta gamma {PASSAGE}", "en", "src1", 3, *EXTRA),
        (2, f"other words before {PASSAGE} and after", "en", "src1", 3, *EXTRA),
        (2, f"other words before {PASSAGE} and after", "en", "src1", 3, *EXTRA),
        (3, None, None, None, None, *[None] * 7),
        (4, "", "en", "src2", 0, *EXTRA),
        (5, " \t\n ", "de", "src2", 4, *EXTRA),
        (6, LONG, "fr", "src3", len(LONG), *EXTRA),
        (None, f"Alpha beta gamma {PASSAGE}", "en", "src1", 3, *EXTRA),
        (7, "Released under the MIT License. naïve 日本語 \U0001f600", "xx", "src4", 3, *EXTRA),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_divergence(docs, nothing):
    rows = divergence.judge(docs).collect()
    assert len(rows) == 9 and not any(r.kept for r in rows if r.doc_id in (3, 4, 5))
    long = by_id(rows)[6]
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (60_001, 60_000, True)
    assert by_id(rows)[3].n_words == 0
    assert divergence.judge(nothing).count() == 0


def test_divergence_windows_and_lines(spark):
    df = spark.createDataFrame([(1, "a b c a b c d\nx\n \nx\nx y", "en"), (2, "a a a a", "en"), (3, "a b c", "en")], "doc_id bigint, text string, lang string")
    rows = by_id(divergence.judge(df).collect())
    assert (rows[1].n_repeat_words, rows[1].n_dup_lines) == (6, 1)
    assert rows[2].n_repeat_words == 4 and rows[3].n_repeat_words == 0


def test_divergence_drops_another_language_only_when_long(spark):
    clean = [(i, " ".join(["the", "of", f"w{i}", "and", f"v{i}", "to", f"u{i}", "is"] * 20), "en") for i in range(60)]
    odd = " ".join(f"Q{i}#|" for i in range(200))
    df = spark.createDataFrame([*clean, (100, odd, "en"), (101, odd[:300], "en"), (102, odd, "zz")], "doc_id bigint, text string, lang string")
    rows = by_id(divergence.judge(df).collect())
    assert not rows[100].kept and not rows[100].base_failed
    assert rows[102].kept  # its language has too few documents
    assert rows[100].class_distance > 0.3


def test_packed_ids(spark, docs, nothing):
    for frame, n in ((docs, 9), (nothing, 0)):
        folder = new_folder(spark, "ids")
        manifest = bitpack.write_ids(frame, public_tokenizers.path("word_bpe_49k.json"), folder, 16, shard_ids=50_000)
        if not n:
            assert manifest.count() == 0
            continue
        rows = sorted(bitpack.read_ids(spark, folder, manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
        assert [r.n_tokens for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
        assert rows[-1].start == sum(r.n_tokens for r in rows[:-1])
        assert manifest.count() > 1


def test_packed_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [
        "a <|endoftext|> b", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> é<|EndOfText|> x", "<|endoftext|>",
        "it<|endoftext|>'s naïve<|startoftext|> 日本語<|endoftext|>語", "<|endoftext<|endoftext|>|> <| endoftext |>", "plain words only",
    ]
    folder = new_folder(spark, "ids")
    manifest = bitpack.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, folder, 16)
    found = {r.doc_id: [int.from_bytes(r.ids_le[i : i + 4], "little") for i in range(0, len(r.ids_le), 4)] for r in bitpack.read_ids(spark, folder, manifest).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert found[0] == [320, 49407, 321, 1]
    assert found == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_pack_any_width(bits):
    import numpy as np

    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 10_001).astype(np.int64)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
    writer = bitpack.ShardWriter(bits)
    ends = np.array([0, 5000, 10_001])
    writer.add([3, 1, 2], ids, ends)
    shard = bitpack.ShardReader(writer.content())
    assert shard.docs.tolist() == [3, 1, 2]
    assert (shard.document(1) == ids[:5000]).all() and (shard.document(2) == ids[5000:]).all() and not len(shard.document(0))
    assert (shard.ids(4095, 8193) == ids[4095:8193]).all()


def test_bpe(docs, nothing):
    coded = bpe.recode(docs, RANKS, public_tokenizers.PATTERN)
    assert {"component_id", "ids", "decoded"} <= set(coded.columns)
    for row in coded.collect():
        assert bytes(row.decoded).decode() == (row.text or "")
    again = bpe.decode(coded.drop("decoded"), RANKS)
    assert {(r.doc_id, bytes(r.decoded)) for r in again.collect()} == {(r.doc_id, bytes(r.decoded)) for r in coded.collect()}
    assert bpe.recode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "a [/INST] b \\[INST] \\", "x"), (1, 1, "assistant", "</s>", "x"), (1, 1, "assistant", "</s>", "x"),
        (2, 0, None, None, None), (None, 3, "tool", "t" * 1_200_000, "x"), (None, 4, "assistant", "last", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss string")
    chunks = chat.format_conversations(turns)
    out = {r.conversation: r for r in chat.summaries(chunks).collect()}
    assert (out[1].n_turns, out[1].loss_chars) == (3, 8)
    assert (out[2].n_turns, out[2].loss_chars) == (1, 0)
    assert (out[None].n_turns, out[None].loss_chars) == (2, 4)
    texts = "".join(r.text for r in chunks.where("conversation = 1").orderBy("part").collect())
    assert chat.recovered(texts) == [(r[2], r[3]) for r in rows[:3]]
    assert chat.summaries(chat.format_conversations(turns.where("false"))).count() == 0


def test_chat_rejects_what_is_no_turn():
    for text in ("x", "<s>[INST] a", "<s>[INST] a [INST] b [/INST]", "<s>[OUT] a [/INST]", "<s>[INST] a [/INST] "):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def test_long_conversations_keep_their_order(spark):
    turns = spark.range(5_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "string(id) AS text")
    chunks = chat.format_conversations(turns)
    assert chunks.count() > 10
    found = []
    for row in chunks.orderBy("first_turn", "part").collect():
        found += [text for _, text in chat.recovered(row.text)]
    assert found == [str(i) for i in range(5_000)]


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)  # nothing to learn from
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 9 and all(r.score < 0.5 for r in rows)
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_learns_stems_and_reads_whole_texts(spark):
    rows = [(i, f"plain words number {i} are here" + (f" badword{i % 7} too" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    rows += [(1000, "filler " * 150_000 + "badwordzz", 1), (1001, "filler " * 150_000, 0), (1002, "badwordnew", 1), (1003, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 600").select("doc_id", "toxic"))
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert scores[1000] > 0.5 > scores[1001] and scores[1002] > 0.5 > scores[1003]


def test_toxicity_thresholds_cover_all_labelled_rows(spark):
    """A small sample of each class gives the weights; thresholds see the true shares of the classes."""
    rows = [(i, f"same words here {i % 3}" + (" badword" if i % 10 in (0, 1, 2) else ""), int(i % 10 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"), per_class=200)
    # Two of three texts with the word are clean, so the fewest errors call all texts clean.
    predicted = toxicity.score(df, model).where("score >= 0.5").count()
    assert predicted == 0


def mixed(df, **options):
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    return mixing.mix(df, levels, [{"en": 1.0}, {}], F.size(F.split("text", " ")), **options)


def test_mixing(docs, nothing):
    rows = mixed(docs, share=1.0, max_epochs=1).collect()
    assert {r.mix_epoch for r in rows} == {0} and len(rows) >= 7
    assert {r.mix_epoch for r in mixed(docs, share=2.0, max_epochs=2).collect()} == {0, 1}
    assert mixed(nothing).count() == 0


def test_mixing_passes_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 5)], "l string, s string, tokens bigint"
    )
    plan = mixing.leaf_budgets(leaves, ["l", "s"], [{"a": 3.0, "b": 1.0}, {}], 400 / 2015, 1)
    assert {(r.l, r.s): r.budget for r in plan.collect()} == {("a", "x"): 10, ("a", "y"): 290, ("b", "x"): 95, ("b", "y"): 5}
    # All of a's children are exhausted, so the rest goes to b.
    plan = mixing.leaf_budgets(leaves, ["l", "s"], [{"a": 99.0, "b": 1.0}, {}], 1500 / 2015, 1)
    assert {(r.l, r.s): r.budget for r in plan.collect()} == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 485, ("b", "y"): 5}


def test_mixing_prefix_is_whole_over_buckets(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'w' AS text", "'en' AS lang", "'s' AS source")
    rows = mixed(df, share=0.37, max_epochs=1)
    assert rows.count() == 7_400 and rows.select("doc_id").distinct().count() == 7_400
    assert mixed(df, share=1.37, max_epochs=2).where("mix_epoch = 1").count() == 7_400


def test_kd_search(spark):
    rows = [
        (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 2.0]), (9, [-3.0, -4.0]), (100, [1.0]), (150, [1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id bigint, embedding array<double>, score string")
    found = kdsearch.top_k(df, F.col("id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (50, 1, 1, 5 * 65536), (50, 2, 2, 5 * 65536), (50, 3, 9, -11 * 65536), (100, 1, 7, 65536),
    ]
    assert kdsearch.top_k(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_kd_search_over_shards(spark):
    import numpy as np

    random = np.random.default_rng(3)
    vectors = random.integers(-3, 4, (700, 6))
    vectors[200:450] = vectors[200]  # one very common vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = kdsearch.top_k(df, F.col("id") % 7 == 0, scale=1.0, shard_rows=100, block_queries=20).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    products = vectors @ vectors.T
    for q in range(0, 700, 7):
        expected = sorted((-int(products[q, j]), j) for j in range(700) if j != q)[:5]
        assert found[q] == [(j, -s) for s, j in expected]


def test_simhash(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 9
    groups = {r.doc_id: r.component_id for r in rows}
    assert groups[None] == 1 and groups[3] == groups[4] == groups[5] == 3
    assert {r.fp for r in rows if r.doc_id == 3} == {0}
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_large_postings(spark, monkeypatch):
    """Postings above the limit are solved in parts with the same result."""
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(a, 30)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id bigint, fp bigint")
    small = simhash._posting_edges(simhash.byte_postings(df.select("fp").distinct(), 2), 2, 6)
    expected = {r.component for r in components(small.where("key is null").select("src", "dst")).collect()}
    source = simhash._posting_edges
    monkeypatch.setitem(source.__globals__, "POSTING_ROWS", 40)
    found = df.select("fp").distinct()
    ball = simhash._ball_edges(found.select(F.col("fp").alias("src")))
    assert {r.component for r in components(ball).collect()} == expected
    words = found.select(F.col("fp").alias("node"), F.array("fp").alias("words"))
    block = simhash._block_edges(found.select(F.lit(1).alias("key"), F.col("fp").alias("src")), words, 2)
    assert {r.component for r in components(block).collect()} == expected


def test_keep_one(docs):
    rows = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7] and sum(r.doc_id is None for r in rows) == 1
    assert set(rows[0].asDict()) == set(docs.columns)


def test_repeated_lines_do_not_make_texts_alike(spark):
    filler = "on and on " * 150
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(120)) + " " + filler) for i in range(4)]
    rows.append((9, rows[2][1].replace("w2x60", "changed")))
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3]


def test_similar_groups_by_exact_jaccard(spark):
    """Pairs around the limit, texts of 20 to 5,000 shingles, contained or changed, against brute force."""
    rows = []
    for n in (20, 60, 70, 200, 1000, 5000):
        for k, share in enumerate((0.70, 0.75, 0.79, 0.80, 0.801, 0.85, 0.90) * (3 if n < 5000 else 1)):
            words = [f"w{n}a{k}b{j}" for j in range(n + 4)]
            cut = round((n + 4) * share) if k % 2 else n + 4
            gone = (1 - share) / (1 + share) * n / 5
            other = words[:cut] if k % 2 else [f"new{j}" if int(j * gone / n) != int((j + 1) * gone / n) else w for j, w in enumerate(words)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    expected = {i: i for i in sets}
    for i in range(0, len(rows), 2):
        a, b = sets[i], sets[i + 1]
        if 10 * len(a & b) >= 8 * len(a | b):
            expected[i + 1] = i
    assert 10 < sum(i != j for i, j in expected.items()) < len(rows) / 2 - 10
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == expected


def test_prefixes_of_shared_keys(spark):
    rows = [(k % 700, n) for n, k in enumerate(range(1400))] + [(10_000 + k, k) for k in range(500)] + [(-1, k) for k in range(30_000)]
    found = simhash._shared(spark.createDataFrame(rows, "key bigint, node bigint")).collect()
    assert sorted((r.key, r.node) for r in found) == sorted((k, n) for k, n in rows if k < 10_000)
    assert all(r.first == (0 if r.key == -1 else r.key) for r in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000)]
    out = components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(301)}, **{j: 1000 for j in range(1000, 1100)}}


def test_licences(docs, nothing):
    rows = by_id(licences.licences(docs).collect())
    assert (rows[7].n_base, rows[7].first_word, rows[7].base_labels, rows[7].labels) == (1, 3, "mit", "mit")
    assert (rows[3].n_words, rows[3].labels, rows[3].score, rows[3].first_word) == (0, "", 0.0, None)
    assert licences.licences(nothing).count() == 0


def test_licences_by_template(spark):
    notice = licences.TEMPLATES[3][1].title()
    rows = [(1, f"intro {notice}. end", 1), (2, "hereby granted free", 1), (3, "GNU  General-Public LICENSE gnu general public license", 1), (3, "none", 1)]
    rows += [(i, f"nothing of it {i}", 1) for i in range(10, 40)]
    out = licences.licences(spark.createDataFrame(rows, "doc_id bigint, text string, labels int")).collect()
    found = {(r.doc_id, r.n_words > 1): r for r in out}
    assert found[1, True].labels == "mit" and found[1, True].base_labels == "" and found[1, True].score > 0.9
    assert found[2, True].labels == ""
    assert (found[3, True].n_base, found[3, True].last_word, found[3, True].base_labels) == (2, 4, "gpl")
    assert found[3, False].labels == ""


def plain_labels(texts):
    """Labels and best scores from every template at every position of every text."""
    import math
    import re

    words = {i: re.findall(licences.WORD, t.lower()) for i, t in texts.items()}
    df = {w: sum(w in set(ws) for ws in words.values()) for w in licences.WORDS}
    weight = {w: math.log((1 + len(texts)) / (1 + n)) for w, n in df.items()}
    by_template = {}
    for template, label, place, word, must in licences.ROWS:
        by_template.setdefault((template, label), []).append((place, word, must))
    out = {}
    for i, ws in words.items():
        labels, best = set(), 0.0
        for (_, label), rows in by_template.items():
            for at in range(-40, len(ws)):
                there = [0 <= at + p < len(ws) and ws[at + p] == w for p, w, _ in rows]
                share = sum(weight[w] for (_, w, _), t in zip(rows, there) if t) / sum(weight[w] for _, w, _ in rows)
                if all(t or not must for (_, _, must), t in zip(rows, there)) and share >= licences.MIN_SCORE:
                    labels.add(label)
                    best = max(best, share)
        out[i] = (labels, best)
    return out


def test_licences_of_several_notices(spark):
    apache, mit, gpl, bsd, isc = (licences.TEMPLATES[k][1] for k in (1, 3, 5, 10, 11))
    # The words of the GNU notice that no mandatory phrase holds stand before it, and most are changed in the notice.
    changed = gpl.replace("redistribute", "pass").replace("modify", "alter").replace("published", "issued").replace("foundation", "group")
    kinds = [mit] * 100 + [apache] * 100 + [isc] * 50 + [bsd] * 5
    kinds += [f"{bsd} {mit} {apache} {isc}", f"redistribute modify published foundation {bsd} {changed} x {isc}", " y ".join(t[1] for t in licences.TEMPLATES)]
    texts = {i: f"start {kind} of {i}" for i, kind in enumerate(kinds)}
    plain = plain_labels(texts)
    assert plain[255][0] == {"bsd", "mit", "apache-2.0", "isc"}
    rows = licences.licences(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = set(row.base_labels.split(",")) - {""}
        assert set(row.labels.split(",")) - {""} == plain[row.doc_id][0] | base
        assert base or abs(row.score - plain[row.doc_id][1]) < 1e-6


def test_repeats(docs, nothing):
    rows = substrings.remove_repeats(docs).collect()
    out = by_id(rows)
    assert len(rows) == 9 and out[1].n_removed == 0
    assert [r.n_removed for r in rows if r.doc_id == 2] == [60, 60] and out[2].text == "other words before and after"
    assert out[None].n_removed == 0 and out[None].text.startswith("Alpha")
    assert out[5].text == " \t\n " and out[6].n_removed == 0 and out[3].n_words == 0
    assert substrings.remove_repeats(nothing).count() == 0


def test_repeats_of_one_id_are_told_apart(spark):
    rows = [(1, PASSAGE), (2, f"first {PASSAGE}"), (2, f"{PASSAGE} second row")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, PASSAGE), (2, "first"), (2, "second row")]


def plain_repeats(rows, window=13):
    least = {}
    for i, text in rows:
        words = text.split()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for a in range(len(words) - window + 1):
            if least[tuple(words[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


def test_repeats_in_large_buckets(spark, monkeypatch):
    import random

    random.seed(5)
    line = [f"l{i}" for i in range(9)]
    rows = []
    for i in range(300):
        words = [random.choice("abcdef") for _ in range(random.randint(5, 60))]
        at = random.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + line * random.randint(0, 3) + words[at:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = plain_repeats(rows)
    got = {r.doc_id: " ".join(r.text.split()) for r in substrings.remove_repeats(df).collect()}
    assert got == expected
    # All buckets are too large, so every window is dealt out by its own hash.
    kmers = spark.createDataFrame([(substrings._pack(*packed(i, t)),) for i, t in rows if len(t.split()) >= 13], "block binary")
    runs = substrings._hot_runs(kmers, 13).collect()
    gone = {}
    for r in runs:
        gone.setdefault(r.doc, set()).update(range(r.place >> 16, (r.place >> 16) + 13))
    texts = {i: " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ())) for i, t in rows}
    assert texts == expected


def packed(doc, text):
    import numpy as np

    keys, starts, strings = substrings.super_kmers(substrings.words_of(text), 13)
    rows = np.zeros(len(keys), substrings._ROW)
    rows["doc"], rows["place"] = doc, starts << 16
    return rows, strings

