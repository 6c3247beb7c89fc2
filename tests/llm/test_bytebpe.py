"""Byte-level encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import bytebpe
from tideline.llm.queries import byte_model


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bytebpe.ByteBPE(bytebpe.load(path)), Tokenizer.from_file(path)


def _wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_random_texts(both):
    own, library = both
    rng = random.Random(4)
    letters = list(" abcdeéthe\n\t😀0192中文ßü.,;|  \x00عĀ'\r\x85 \xa0") + [
        "ing", "tion", " the", "    ", "<|endoftext|>", "'ll", "'S", " ", chr(0x16EA0), chr(0x11DE0), chr(0x558),
    ]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, joined in zip(texts, own.encode_all(texts), strict=True):
        ids = [int(i) for i in joined.split(",")] if joined else []
        assert ids == _wanted(library, text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_character(both):
    own, library = both
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c}  " for c in chars]
    wanted = [",".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode_all(texts) == wanted


def test_random_ids(both):
    own, library = both
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 50256)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pairs_agree_with_merging(both):
    own, _ = both
    rng = np.random.default_rng(6)
    left, right = rng.integers(0, 3000, 20_000), rng.integers(0, 3000, 20_000)
    for a, b, fits in zip(left, right, own.compatible(left, right), strict=True):
        assert (own.merged(own.tokens[a] + own.tokens[b]) == [a, b]) == fits
    words = [own.tokens[a] + own.tokens[b] for a, b in zip(left, right, strict=True)]
    assert [t.tolist() for t in own.merged_together(words)] == [own.merged(w) for w in words]
    assert all((own.merged(t) == [i]) == own.alone[i] for i, t in enumerate(own.tokens[:20_000]))


def test_a_small_vocabulary_with_overlapping_merges():
    merges = [("a", "a"), ("b", "a"), ("aa", "a"), ("a", "b"), ("ab", "a")]
    chars = {b: c for c, b in bytebpe.byte_of_char().items()}
    vocab = {chars[b]: b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    file = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}}
    file |= {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}}
    own = bytebpe.ByteBPE(json.dumps(file).encode())
    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for word, joined in zip(words, own.encoded_words(words), strict=True):
        parts = list(word)
        for x, y in merges:
            k = 0
            while k + 1 < len(parts):
                if parts[k : k + 2] == [x, y]:
                    parts[k : k + 2] = [x + y]
                k += 1
        assert joined == ",".join(str(vocab[p]) for p in parts)


def test_long_stretches_take_time_in_proportion(both):
    own, library = both
    rng = random.Random(8)
    for text in ("A" * 400_000, "".join(rng.choice("abcdefghij") for _ in range(400_000))):
        start = time.perf_counter()
        ids = own.encode(text)
        assert time.perf_counter() - start < 20
        assert ids == _wanted(library, text)


def test_forgetting_changes_nothing(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    monkeypatch.setattr(bytebpe, "LONGEST", 4)
    for text in ("some words that are forgotten some words that are not", "some", "more words <|endoftext|>"):
        assert own.encode(text) == _wanted(library, text)


def test_unsupported_rules():
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        file = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
        with pytest.raises(ValueError):
            bytebpe.ByteBPE(json.dumps(file | change).encode())


def test_documents(docs, both):
    _, library = both
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in bytebpe.digests(docs, byte_model()).collect():
        ids = _wanted(library, texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, both, monkeypatch):
    _, library = both
    monkeypatch.setattr(bytebpe, "SLICE_CHARS", 100)
    rows = bytebpe.encoded(odd_docs, byte_model()).collect()
    want = sorted((r["doc_id"] or -1, _wanted(library, r["text"])) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == want
    assert sorted(r["decoded"] for r in rows) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert bytebpe.digests(no_docs, byte_model()).count() == 0
