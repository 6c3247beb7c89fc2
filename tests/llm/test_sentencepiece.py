"""Encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece as library

from tideline.llm import sentencepiece
from tideline.llm.queries import piece_model


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.PieceModel(sentencepiece.load(path)), library.SentencePieceProcessor(model_file=path)


def test_random_texts(both):
    own, wanted = both
    rng = random.Random(4)
    letters = list(" abcdeéthe▁\n\t😀0192中文ßü.,;|  \x00ع") + ["ing", "tion", " the", "    ", "<s>", "</s>", "<0x41>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == wanted.encode(text)
        assert own.decode(ids) == wanted.decode(ids)


def test_random_ids(both):
    own, wanted = both
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == wanted.decode(ids)


def test_forgetting_changes_nothing(both, monkeypatch):
    own, wanted = both
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 3)
    text = "some words that are forgotten some words that are not"
    assert own.encode(text) == wanted.encode(text)


def test_long_stretches_take_time_in_proportion(both):
    own, wanted = both
    rng = random.Random(8)
    for text in ("ab" * 200_000, "".join(rng.choice("abcdefghij") for _ in range(400_000))):
        start = time.perf_counter()
        ids = own.encode(text)
        assert time.perf_counter() - start < 15
        assert ids == wanted.encode(text)


def test_documents(docs, both):
    _, wanted = both
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in sentencepiece.digests(docs, piece_model()).collect():
        ids = wanted.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(wanted.decode(ids).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, both):
    _, wanted = both
    rows = sentencepiece.encoded(odd_docs, piece_model()).collect()
    want = sorted((r["doc_id"] or -1, wanted.encode(r["text"] or "")) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == want
    assert sentencepiece.digests(no_docs, piece_model()).count() == 0
