"""What earlier reviews found: each case that once went wrong."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from tablepulse.llm import bitpack, divergence, kdsearch, licences, queries, simhash, spelling


def test_packed_ids_of_combining_marks(spark, tmp_path):
    """Letters that combine in lower case only, added tokens and odd white space, as the tokenizers library takes them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, some = Tokenizer.from_file(path), random.Random(1)
    signs = ["T̈", "J̌", "W̊", "H̱", "a", "B", "É", "é", "İ", "ß", "Å", "ﬁ", "1", ",", "'s", "'LL"]
    signs += [" ", "  ", "\n", " ", "\x1c", "<|endoftext|>", "<|", "日本", "ͅ", "\U0001f44d"]
    texts = ["".join(some.choice(signs) for _ in range(some.randrange(25))) for _ in range(5000)] + [None, "T̈", "J̌ W̊"]
    cache, tokens = bitpack.word_cache(path), bitpack.token_pattern(path)
    for at in range(0, len(texts), 40):
        # Every second part has no added token and goes the other way.
        part = [t if at % 80 else t and t.replace("<|endoftext|>", "") for t in texts[at : at + 40]]
        flat, ends = bitpack.encode_texts(pa.array(part, pa.string()), cache, tokens)
        starts = np.r_[0, ends[:-1]]
        assert [flat[a:b].tolist() for a, b in zip(starts, ends)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_large_components_take_part(spark):
    rows = [(0, [600_000.0, 1.0]), (50, [1.0, 2.0]), (1, [-3.0, 4.0]), (2, [0.5, 600_000.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in kdsearch.top_k(table, F.col("id") % 50 == 0).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    assert found == {(q, i): sum(a * b for a, b in zip(whole[q], whole[i])) for q in (0, 50) for i in whole if i != q}
    with pytest.raises(Exception, match="may not fit a long"):
        kdsearch.top_k(spark.createDataFrame([(0, [1e14]), (1, [1e14])], table.schema), F.col("id") % 50 == 0).collect()


def test_divergence_judges_alike_at_any_size(spark):
    """A text is kept or dropped by its own language's sums, however few its documents are."""
    plain = "the cat and the dog of the house went to the town and came back in the evening with a friend of mine "
    odd = "%%%% #### @@@@ {{{{ }}}} ;;;; 1111 2222 ==== ++++ "
    texts = [(i, f"{plain * 6} number{i}") for i in range(20)] + [(99, odd * 12)]
    few = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id bigint, text string, lang string")
    many = few.unionByName(few.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(few.withColumn("doc_id", F.col("doc_id") + 2000))
    kept = lambda df: {r.doc_id % 1000: r.kept for r in divergence.judge(df).collect()}
    assert kept(few) == kept(many)


NOTICES = {
    "licensed under cc by nc 4 0": "cc-by,cc-by-nc-4.0",
    "licensed under cc zz nc 4 0": "",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission to use copy modify and or distribute this software for any purpose zz yy without fee is hereby granted": "",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "you may not use this file except zz compliance with the license you may obtain a copy of the license at": "",
}


def test_phrases_are_verified_with_their_function_words(spark):
    rows = list(enumerate(NOTICES)) + [(100 + i, f"other words {i} here") for i in range(200)]
    found = licences.licences(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.labels for r in found.collect() if r.doc_id < 100} == dict(enumerate(NOTICES.values()))


def test_licence_sql_on_files_with_several_notices(spark):
    """The query and its SQL on a corpus in which files join two to four notices."""
    some = random.Random(4)
    texts = [t for _, t, _ in licences.TEMPLATES]
    rows = [(i, " zz ".join(some.sample(texts, 1 + i % 4)) + f" word{i}", "en", "s") for i in range(120)] + [(500, None, None, None)]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    duck = duckdb.connect()
    duck.register("documents", docs)
    found = licences.licences(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").select("doc_id", "text"))
    assert compare.differences(found, duck, queries.SQL["op9_licences"]) == []


def test_mixing_sql_with_null_labels(spark):
    rows = [(i, "w " * (1 + i % 40), [None, "en", "de"][i % 3], [None, "src0", "src5", "x"][i % 4]) for i in range(300)]
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = queries.mixed(docs).select("doc_id", "lang", "source", "mix_epoch", "mix_tokens", "mix_budget")
    assert compare.differences(found, duck, queries.SQL["op6_mixing"]) == []


def test_stages_keep_columns_of_the_names_that_they_make(spark, folder):
    rows = [(i, "some words of a text " * 4, "en", "src1", 80, 7, 8, 9) for i in range(30)] + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, mix_epoch int, n_removed int")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        assert {(r.n_words, r.mix_epoch, r.n_removed) for r in found.collect()} <= {(7, 8, 9), (None, None, None)}, name


def test_any_order_of_shingles_lets_similar_sets_meet():
    """What a sample calls common only orders the prefixes: no order loses a pair of 0.8 or more."""
    some = np.random.default_rng(3)
    universe = np.unique(some.integers(0, 2**63, 400).astype(np.uint64))
    empty = universe[:0], np.zeros(0, np.int64)
    orders = [empty] + [(np.sort(some.choice(universe, n, False)), some.integers(1, 9, n)) for n in (1, 50, len(universe))]
    for size in (5, 40, 200):
        for _ in range(20):
            left = np.sort(some.choice(universe, size, False))
            gone = some.permutation(size)[: size // 9]
            right = np.delete(left, gone)
            assert len(right) / size >= 0.8
            for common, ranks in orders:
                keys = [set(simhash.prefix_keys(v.copy(), 0.8, common, ranks).tolist()) for v in (left, right)]
                assert keys[0] & keys[1]


def test_one_text_of_each_group_stays_whatever_its_id(spark):
    """Unlike texts of one id all stay, copies of an id go with their group, and rows without an id are compared too."""
    texts = {name: " ".join(f"{name}{j}" for j in range(100)) for name in "abcdefg"}
    near = {name: text + " more" for name, text in texts.items()}
    rows = [
        (1, texts["a"]), (1, texts["b"]), (1, None),
        (2, texts["c"]), (2, texts["d"]), (0, near["d"]), (3, texts["d"]),
        (4, texts["e"]), (4, texts["e"]), (4, near["e"]),
        (None, texts["f"]), (None, texts["f"]), (None, near["f"]),
        (None, near["g"]), (None, texts["g"]), (9, texts["g"]), (8, near["g"]),
    ]
    docs = spark.createDataFrame([(*row, number) for number, row in enumerate(rows)], "doc_id bigint, text string, mark int")
    for parts in (1, 5):
        found = simhash.keep_one(docs.repartition(parts, "mark"))
        assert found.columns == docs.columns
        kept = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "no")[0]) for r in found.collect())
        assert kept == [(-1, "f"), (-1, "g"), (0, "d"), (1, "a"), (1, "b"), (1, "n"), (2, "c"), (4, "e"), (8, "g")]


def test_alike_sets_have_a_part_that_meets():
    """On both sides of the sizes at which sets are dealt into parts: a common key, and bits and sizes within the share."""
    some, share = np.random.default_rng(4), 0.2 / 1.8
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    for size in (1, 9, 80, 330, 399, 401, 500, 640, 801, 1000, 1601, 7000):
        for at in range(10):
            base = np.unique(some.integers(0, 2**64, size, np.uint64))
            n = len(base)
            # Contained in the other, or with words of its own: as unlike as 0.8 lets them be, or a little less.
            common = -(-8 * n // 10) if at % 2 else -(-16 * n // 18)
            own = some.integers(0, 2**64, 0 if at % 2 else (10 * common // 8) - n, np.uint64)
            other = np.unique(np.r_[some.choice(base, common, False), own])
            assert 10 * len(np.intersect1d(base, other)) >= 8 * len(np.union1d(base, other))
            left, right = (list(simhash._pieces(v, name, 0.8, *none)) for name, v in ((1, base), (2, other)))
            sides = [[(k, words) for _, words, keys in pieces for k in keys.tolist()] for pieces in (left, right)]
            by_key = dict(sides[0])
            met = [simhash._linked(np.array([by_key[k], words]), 0, 0, share) for k, words in sides[1] if k in by_key]
            assert any((0, 1) in zip(a.tolist(), b.tolist()) for a, b in met)


def test_alike_texts_stay_alike_whatever_their_fingerprints(spark):
    """Words chosen so that votes are near ties: 80 percent alike, with majority bits that differ like those of strangers."""
    words = [f"w{i}" for i in range(6000)]
    digests = np.concatenate([simhash.shingle_hashes(w, 1) for w in words])
    values = digests.view(">u8").ravel().astype(np.uint64)
    votes = []
    for number in range(4):
        mixed = values
        if number:
            mixed = (values ^ np.uint64(0x9E3779B97F4A7C15 * number & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed = mixed ^ (mixed >> np.uint64(31))
            votes.append(np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1))
        else:
            votes.append(np.unpackbits(digests, axis=1))
    votes = np.hstack(votes).astype(np.int64) * 2 - 1
    free, total, core = np.ones(len(words), bool), np.zeros(votes.shape[1], np.int64), []

    def pick(toward):
        best = int(np.argmax(np.where(free, votes @ toward, -(1 << 40))))
        free[best] = False
        return best

    for _ in range(96):
        core.append(pick(-total))
        total = total + votes[core[-1]]
    side = np.where(np.arange(len(total)) % 2, 1, -1)
    own = [pick(side) for _ in range(12)], [pick(-side) for _ in range(12)]
    left, right = (np.sign(total + votes[own[i]].sum(axis=0)) for i in range(2))
    assert ((left > 0) != (right > 0)).sum() > 75
    rows = [(i, " ".join(words[j] for j in core + own[i])) for i in range(2)]
    rows += [(i, " ".join(words[2000 + i * 200 : 2100 + i * 200])) for i in range(2, 9)]
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=1)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i if i > 1 else 0 for i in range(9)}


def test_words_are_made_once_per_run(spark):
    """No filter below the count works out the dropped letter a second time; short and accented runs stay exact."""
    rows = [(i, "Apple Crème CRÈME École straße") for i in range(400)]
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    # Words of five letters lose one in some rows and are no words there.
    assert counts["apple"] < 400 and {"crÈme", "École"} < set(counts)
    found = spelling.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), min_count=0)
    assert {r.word: r.n for r in found.collect()} == {w: n for w, n in counts.items() if len(w) >= 5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32" in plan and not [line for line in plan.splitlines() if "Filter" in line and "crc32" in line]


@pytest.mark.parametrize("a, b", [("", ""), ("", "x"), ("x", ""), ("abc", "abc"), ("abcd", "abc"), ("abc", "abcd"), ("abXd", "abYd"), ("éa", "éb"), ("a", "b")])
def test_common_prefix(spark, a, b):
    found = spark.createDataFrame([(a, b)], "a string, b string").select(spelling._common(F.col("a"), F.col("b"))).first()[0]
    assert found == len(os.path.commonprefix([a, b]))
