"""The registered queries against SQL, or against a plain computation where SQL has no form."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from tablepulse.llm import bpe
from tablepulse.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, folder, name):
    assert compare.differences(QUERIES[name](spark, folder), duck, SQL[name]) == []


@pytest.mark.parametrize("name", ["op1_divergence", "op9_licences"])
def test_native_queries_run_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packed_ids(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for doc_id in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_packed_ids"](spark, folder).collect())) == expected


def test_byte_bpe(spark, folder, texts):
    ranks = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for row in QUERIES["op3_byte_bpe"](spark, folder).collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()))
        assert row.decoded_sha256 == digest(texts[row.doc_id].encode())


def plain_fingerprint(text: str, k: int = 3) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], bits: int) -> dict[int, int]:
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= bits:
                    least[a], changed = least[b], True
    return least


def test_simhash_components(spark, folder, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = plain_components(prints, 2)
    rows = QUERIES["op8_simhash_components"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", least[i]) for i in texts}


def test_toxicity_on_held_out_rows(spark):
    """Labels that the model has not seen; the larger table has some hundred toxic ones."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert sum(b for a, b in held if a) / sum(a for a, _ in held) >= 0.75


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.landed(stage(spark, docs, folder), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == before
    # Whatever is encoded is the text that the stage before kept.
    kept = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert all(kept[r.doc_id] == r.decoded_sha256 for r in last.collect())
