"""Byte-level BPE against the tokenizer library, and the round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(ranks, library):
    rng = random.Random(3)
    letters = "ab s t re ve ll m d ''''  \n\t\r 　é日12٣!?_-~.'sS'LL\U0001f600\u0088"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    texts += ["", " ", "\n", "'", "'s", "'l", "'r", "a'", "''s", " 's", "'re're", "x" * 5000 + "  " + "é" * 3000, "ab" * 200_000, " " * 100_000]
    codec = bpe.Codec(ranks)
    for text, packed in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == library.encode_ordinary(text), text[:80]
        assert codec.decode(ids) == text.encode()
        assert codec.offsets(ids).tolist() == np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in ids.tolist())])[:-1].tolist()


def test_same_classes_as_the_library(ranks):
    points = [p for p in range(bpe.SEPARATOR) if not 0xD800 <= p < 0xE000]
    single = {bytes([i]): i for i in range(256)}
    for pattern, value in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.BLANK_ALONE)):
        one = tiktoken.Encoding(f"one{value}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        wrong = [hex(p) for p in points if bool(one.encode_ordinary(chr(p))) != (bpe.code_point_classes()[p] == value)]
        assert wrong == []


def test_both_merges_agree(ranks):
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choice("aeinrst é日") for _ in range(rng.randint(1, 120))).encode()
        assert bpe.merge_long(piece, ranks) == bpe.merge_short(piece, ranks)


def test_operators_on_odd_rows(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, "Über 12's  \n", 0), (3, "Über 12's  \n", 0), (None, "x" * 300_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = bpe.encode_documents(docs, PATH)
    found = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    assert found == {(i, tuple(library.encode_ordinary(t or ""))) for i, t, _ in rows}
    decoded = bpe.decode_documents(encoded, PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.data).decode()) for r in decoded) == sorted((i or 0, t or "") for i, t, _ in rows)
    digests = bpe.token_digests(docs, PATH, with_ids=True).collect()
    assert len(digests) == 5
    for r in digests:
        packed = np.array(r.ids, "<u4").tobytes()
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(r.ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), PATH).collect() == []
