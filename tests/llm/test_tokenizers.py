from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from cases import LONG, ROWS, awkward, empty
from gatetally.llm import scan
from gatetally.llm.byte_bpe import byte_bpe, decode, encode, encoding_digests, pieces
from gatetally.llm.token_counts import counter, token_counts

SIGNS = "ab '  \n\t\r.,é日本'srevlltmd09▁\U0001f600\x00<|>  Ünder\x85　"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(259, 32000)]
    made = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    made += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 8))) for _ in range(2000)]
    return [*made, "", " ", "  ", "▁", "'s", " 's", "''s", "x's't", "a" * 3000, "x" * 100 + " " * 200, LONG]


@pytest.fixture(scope="module")
def piece_model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_model():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [3, 128])
def test_counts_equal_the_library(texts, piece_model, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(scan, "BLOCK", 1000 if chunk == 3 else scan.BLOCK)
    got = counter(public_tokenizers.path("piece_bpe_32k.model")).counts(texts)
    assert list(got) == [len(x) for x in piece_model.encode(texts, num_threads=1)]


@pytest.mark.parametrize("chunk", [3, 128])
def test_ids_equal_the_library(texts, byte_model, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(scan, "BLOCK", 1000 if chunk == 3 else scan.BLOCK)
    bpe = byte_bpe("byte_bpe_50k.tiktoken")
    for text, words, ids in zip(texts, pieces(texts), bpe.encode(texts), strict=True):
        assert "".join(words) == text
        assert list(ids) == byte_model.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_scan_equals_a_plain_loop():
    rnd = np.random.default_rng(2)
    transitions = rnd.integers(0, 5, (4, 5)).astype(np.uint8)
    for n in (0, 1, 127, 128, 129, 5000):
        symbols, state, wanted = rnd.integers(0, 4, n).astype(np.uint8), 3, []
        for s in symbols:
            wanted.append(state)
            state = transitions[s, state]
        assert list(scan.scan_states(symbols, transitions, 3)) == wanted


def test_cache_is_bounded():
    cache = scan.Cache(len, most=10, longest=5)
    assert [cache["x" * (i % 8)] for i in range(100)] == [i % 8 for i in range(100)]
    assert all(cache[str(i)] == len(str(i)) for i in range(1000)) and len(cache) + len(cache.older) <= 10
    assert all(cache[str(i % 4)] == 1 for i in range(100)) and cache["3"] == 1
    other = scan.Cache(len)
    assert other["ab"] == 2 and len(cache) + len(cache.older) == 0 and cache["abc"] == 3


def test_counts_of_awkward_rows(spark, piece_model):
    got = token_counts(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = r.text or ""
        n = len(piece_model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert token_counts(empty(spark)).collect() == []


def test_encoding_of_awkward_rows(spark, byte_model):
    coded = decode(encode(awkward(spark)))
    digests = {(r.doc_id, r.text): r for r in encoding_digests(awkward(spark)).collect()}
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = r.text or ""
        ids = byte_model.encode_ordinary(text)
        assert r.ids == ids and bytes(r.decoded) == text.encode()
        assert r.ends == list(np.cumsum([len(byte_model.decode_single_token_bytes(i)) for i in ids]))
        d = digests[r.doc_id, r.text]
        assert d.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert decode(encode(empty(spark))).collect() == [] == encoding_digests(empty(spark)).collect()


def test_null_ids_decode_to_nothing(spark):
    df = spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert bytes(decode(df).first().decoded) == b""


# --- the registered queries, over the whole table

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_count_query_equals_the_library(spark, documents, piece_model):
    from gatetally.llm.queries import op2_token_counts

    rows = op2_token_counts(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id]
        n = len(piece_model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_encoding_query_equals_the_library(spark, documents, byte_model):
    from gatetally.llm.queries import op10_byte_bpe

    rows = op10_byte_bpe(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id]
        ids = byte_model.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
