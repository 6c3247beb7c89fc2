"""Scores of the classifiers by plain Python, n-gram by n-gram."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from tideline.llm import langid, toxicity
from tideline.llm.common import text_bytes

TEXTS = ["", " \t\n", "a", "an Idiot.", "ein Wort mit Ümlaut und 中文", "moron " * 300, "x" * 3000, "one\x0btwo\x00three", "ÄÖ é!"]


def _ascii_lower(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def _toxicity(text: str, model: toxicity.Model) -> float:
    """The largest mean of a word's n-gram weights, with its blanks, through the logistic function."""
    best = None
    for word in re.split(rb"[\x20\x09-\x0D]+", _ascii_lower(text.encode())):
        if not word:
            continue
        whole, total, parts = b" " + word + b" ", 0.0, 0
        for size in toxicity.SIZES:
            for at in range(len(whole) - size + 1):
                code = int.from_bytes(whole[at : at + size], "little")
                bucket = (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.BUCKET_BITS)
                total, parts = total + float(model.weights[bucket]), parts + 1
        mean = total / max(parts, 1) + model.bias
        best = mean if best is None else max(best, mean)
    return 0.0 if best is None else 1 / (1 + math.exp(-max(-40, min(40, best))))


def test_toxicity_scores():
    weights = np.random.default_rng(3).normal(0, 2, 1 << toxicity.BUCKET_BITS).astype(np.float32)
    model = toxicity.Model(weights, -0.5)
    got = model.score(*text_bytes(toxicity.pa.array([*TEXTS, None])))
    assert got == pytest.approx([*(_toxicity(t, model) for t in TEXTS), 0.0], abs=1e-6)


def test_toxicity_of_repeated_documents(spark):
    """Documents that are repeated many times leave the others their place in the sample."""
    calm = [(k, f"a quiet letter about the garden and the rain {k}") for k in range(2)] * 1600
    rows = calm + [(100 + k, f"you are a worthless idiot and a moron {k}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(2)] + [(100 + k, 1) for k in range(8)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, folds=3, held_out=7)
    once = toxicity.fit(docs.distinct(), labels, folds=3, held_out=7)
    assert model.weights is not None and np.array_equal(model.weights, once.weights) and model.bias == once.bias
    low, high = model.score(*text_bytes(toxicity.pa.array(["the garden and the rain", "a worthless idiot"])))
    assert low < high


def _ngrams(text: str) -> list[bytes]:
    """Four bytes around every two that are no blanks, blanks before and after the text."""
    folded = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in _ascii_lower(text.encode())) + b" "
    return [folded[k : k + 4] for k in range(len(folded) - 3) if folded[k + 1] != 32 and folded[k + 2] != 32]


def test_language_judgments():
    """Python sets in place of the filters: the same language wherever the sets tell them apart."""
    own = {
        "de": "der schnelle fuchs und die faulen hunde laufen mit einem wort durch das alte dorf " * 3,
        "en": "the quick fox and the lazy dogs are running through the old village with one word " * 3,
        "fr": "le renard rapide et les chiens paresseux courent dans le vieux village avec un mot " * 3,
    }
    sets = {name: set(_ngrams(text)) for name, text in own.items()}
    filters = langid.train(list(own.values()) * 2, list(own) * 2)
    texts = [*own.values(), "the old dogs", "das alte wort", "les vieux chiens", "", "123 !!", "zzzz qqqq", *TEXTS]
    best, score, _ = filters.judge(*text_bytes(langid.pa.array(texts)))
    for text, k, share in zip(texts, best, score, strict=True):
        grams = _ngrams(text)
        counts = {name: sum(g in known for g in grams) for name, known in sets.items()}
        if not any(c.isalpha() for c in text):
            assert k == -1 and share == 0
        elif sum(counts.values()) and sorted(counts.values())[-1] > sorted(counts.values())[-2]:
            assert filters.languages[k] == max(counts, key=counts.get)
            # The filters are all but empty here: what chance adds or takes off is small.
            assert share == pytest.approx(max(counts.values()) / sum(counts.values()), abs=0.02)
